import math
import random
import re
from collections import Counter

import numpy as np

from quillspan.llm.toxicity import Ordinal, drop_toxic, features, fit, grade, grades_of, place

SCHEMA = "doc_id long, text string, toxic string"


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(rnd.randint(3, 8)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiot", "Scum,", "grobo" + rnd.choice("abcdefghijk") + rnd.choice("xyz")]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_ordinal_on_ordered_grades():
    rnd = np.random.default_rng(0)
    latent = rnd.normal(size=2000)
    found = [np.array([j for j in range(10) if x > j / 3 - 1.5] + [100 + int(rnd.integers(50))]) for x in latent]
    y = (latent > 0.0).astype(int) + (latent > 1.0)
    model = Ordinal.fit(found, y)
    assert model.thresholds[0] < model.thresholds[1]
    scores = np.array([sum(model.weights.get(int(f), 0) for f in x) for x in found])
    severity, _ = model.severity(scores)
    assert [severity[y == k].mean() for k in range(3)] == sorted(severity[y == k].mean() for k in range(3))
    assert (np.round(severity) == y).mean() > 0.85


def test_held_out_accuracy(spark):
    train, test = corpus(800, 1), corpus(300, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in train], SCHEMA)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in train] + [(None, 1, 0), (99999, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = fit(docs, labels)
    held = spark.createDataFrame([(i, t, "x") for i, t, _ in test] + [(None, None, None), (7777, "", "x")], SCHEMA)
    got = {r.doc_id: r for r in grade(held, model).collect()}
    wrong = [i for i, _, y in test if got[i].toxic != bool(y)]
    assert len(wrong) <= 6
    assert not got[None].toxic and not got[7777].toxic
    kept = drop_toxic(held, model)
    assert kept.columns == held.columns and kept.count() == sum(not r.toxic for r in got.values())


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in grade(docs, fit(docs, none)).collect()] == [False] * 3
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(0 <= r.expected_severity <= 2 for r in grade(docs, fit(docs, ones)).collect())
    assert grade(docs.limit(0), fit(docs, none)).collect() == []


def test_grades_follow_density():
    texts = [f"idiot aaa{i}" for i in range(6)] + [f"idiot scum moron bbb{i}" for i in range(6)] + [f"clean words {i}" for i in range(20)]
    g = grades_of([features(t)[0] for t in texts], np.array([1] * 12 + [0] * 20))
    assert set(g[12:]) == {0} and set(g[:6]) == {1} and set(g[6:12]) == {2}


def test_weights_are_those_of_the_plain_objective():
    """Mean loss of the thresholds plus L1: slopes by definition, row by row, vanish where the model stands."""
    rnd = random.Random(4)
    found, y = [], []
    for _ in range(300):
        ill = rnd.random()
        found.append(np.array(sorted({j for j in range(6) if rnd.random() < ill} | {10 + rnd.randrange(8)})))
        y.append(int(ill + rnd.gauss(0, 0.2) > 0.4) + int(ill + rnd.gauss(0, 0.2) > 0.8))
    y, l1 = np.array(y), 2e-3
    model = Ordinal.fit(found, y, steps=20_000, l1=l1)
    assert model.thresholds == sorted(model.thresholds)
    slopes, at_bounds = dict.fromkeys({int(f) for x in found for f in x}, 0.0), [0.0, 0.0]
    for x, g in zip(found, y):
        score = sum(model.weights.get(int(f), 0.0) for f in x)
        for k, bound in enumerate(model.thresholds):
            off = 1 / (1 + math.exp(bound - score)) - (g > k)
            at_bounds[k] -= off / len(y)
            for f in x:
                slopes[int(f)] += off / len(y)
    assert max(map(abs, at_bounds)) < 1e-4 and len(model.weights) > 3
    for f, w in model.weights.items():
        assert abs(slopes[f] + math.copysign(l1, w)) < 1e-4
    seen = Counter(int(f) for x in found for f in x)
    assert all(abs(s) < l1 + 1e-4 for f, s in slopes.items() if f not in model.weights and seen[f] >= 3 and chosen(found, y, f))


def chosen(found, y, f):
    """Whether a feature tells anything about the grade at all, so that the model may use it."""
    with_it = [g > 0 for x, g in zip(found, y) if f in x]
    return 0 < sum(with_it) < len(with_it)


def test_grades_of_rows_by_definition(spark):
    texts = ["Bad bad words, badly", None, "", "fine " * 30_000 + "bad", "ÄRGER bad", "bad", "bad"]
    weights = {place("=bad"): 1.5, place("4badl"): 0.5, place("=ärger"): -0.25}
    model = Ordinal(weights, [0.5, 2.0], 0.6)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in grade(docs, model).collect()}
    for i, t in enumerate(texts):
        words = set(re.findall(r"\w+", (t or "").lower()))
        x = {place("=" + w) for w in words} | {place(f"{n}{w[:n]}") for w in words for n in (4, 5) if len(w) >= n}
        p = [1 / (1 + math.exp(b - sum(weights.get(f, 0.0) for f in x))) for b in model.thresholds]
        assert math.isclose(got[i].expected_severity, sum(p)) and math.isclose(got[i].p_toxic, p[0]) and got[i].toxic == (p[0] >= 0.6)
