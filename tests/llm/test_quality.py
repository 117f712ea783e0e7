import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm.quality import META, ONE, ROUNDS, SHARE, STEPS, SURE, TEXT, CoTrained, Logistic, meta_view, rated, text_view, viewed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, url string"
PAGES = "page_id long, url string, html string"


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        good = rnd.random() < 0.7
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        if not good:
            t = [w.upper() + "!!" for w in t] if rnd.random() < 0.5 else [rnd.choice(t)] * 60
        text = " ".join(t)
        out.append((i, text, "en", rnd.choice(["a", "b"]) if good else rnd.choice(["b", "c"]), len(text), int(good)))
    return out


def test_logistic_separates():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 3))
    y = (x @ [2.0, -1.0, 0.0] > 0.3).astype(float)
    assert ((Logistic(x, y).probability(x) > 0.5) == y).mean() > 0.97


def test_views_exchange_labels_and_combine():
    rnd = np.random.default_rng(2)
    y = (rnd.random(3000) < 0.5).astype(float)
    views = tuple(y[:, None] * 2 + rnd.normal(size=(3000, 4)) * 0.6 for _ in (0, 1))
    model = CoTrained(tuple(v[:60] for v in views), y[:60], lambda work: work(tuple(v[60:2000] for v in views)))
    assert model.exchanged > 500
    p = model.score(tuple(v[2000:] for v in views))
    accuracy = [((p[:, i] > 0.5) == y[2000:]).mean() for i in range(3)]
    assert accuracy[2] > 0.97 and accuracy[2] >= max(accuracy[:2]) - 0.01


def test_held_out_accuracy(spark):
    rows = corpus(700, 3)
    docs = spark.createDataFrame([(*r[:5], "u") for r in rows], DOCS)
    pages = spark.createDataFrame([(r[0], f"http://{'good' if r[5] else 'odd'}.io/x", "<p>") for r in rows[::2]] + [(None, "x", None), (4, "dup", "y")], PAGES)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:300]] + [(None, 1), (9999, 0), (5, None), (6, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rated(docs, pages, labels).collect()}
    assert len(got) == 700 and np.mean([got[r[0]].keep == bool(r[5]) for r in rows[300:]]) > 0.95


def test_odd_rows(spark):
    assert text_view(None) == text_view(" \n") == [0.0] * TEXT and len(text_view("a b")) == TEXT
    assert len(meta_view(None, None, None, None, None)) == META
    docs = spark.createDataFrame([(1, None, None, None, None, None), (1, "", "en", "s", 0, "u"), (None, "x " * 100_000, "en", "s", 200_000, "u")], DOCS)
    pages = spark.createDataFrame([], PAGES)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.keep for r in rated(docs, pages, none).collect()] == [True] * 3
    assert [r.keep for r in rated(docs, pages, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()] == [True] * 3
    assert rated(docs.limit(0), pages, none).collect() == []


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Plain:
    """The same regression row by row: loss, slope and curvature from their definitions."""

    def __init__(self, x, y, ridge=1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.ridge = np.array([ridge] * x.shape[1] + [1e-6])
        self.beta = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            self.newton([(row, label, 1.0) for row, label in zip(x, y)])

    def z(self, row):
        return np.append(np.clip((row - self.mean) / self.scale, -10, 10), 1.0)

    def p(self, row):
        return sigmoid(self.z(row) @ self.beta)

    def newton(self, rows):
        slope, curvature = self.ridge * self.beta, np.diag(self.ridge)
        for row, label, weight in rows:
            z, p = self.z(row), self.p(row)
            slope = slope + weight * (p - label) * z
            curvature = curvature + weight * max(p * (1 - p), 1e-6) * np.outer(z, z)
        self.beta = self.beta - np.clip(np.linalg.solve(curvature, slope), -5, 5)


def test_against_plain_co_training(spark):
    rows = corpus(260, 8)
    docs = spark.createDataFrame([(*r[:5], "u") for r in rows], DOCS)
    pages = spark.createDataFrame([(r[0], f"http://{'good' if r[5] else 'odd'}.io/x", "<p>") for r in rows[::2]], PAGES)
    noise = random.Random(2)
    labels = {r[0]: r[5] if noise.random() < 0.9 else 1 - r[5] for r in rows[:90]}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {r.doc_id: r for r in rated(docs, pages, table).collect()}
    seen = {r.doc_id: (np.array(r.x, dtype=float), np.array(r.meta, dtype=float)) for r in viewed(docs, pages).collect()}
    order = [r.doc_id for r in table.orderBy(F.xxhash64("doc_id")).collect()]
    fold = {i: nth % 10 for nth, i in enumerate(order)}
    own = [i for i in order if fold[i] > 1]
    pool = [i for i in seen if i not in labels]
    models = [Plain(np.array([seen[i][k] for i in own]), np.array([labels[i] for i in own])) for k in (0, 1)]
    for _ in range(ROUNDS):
        said = [{i: m.p(seen[i][k]) for i in pool} for k, m in enumerate(models)]
        for _ in range(STEPS):
            for k in (0, 1):
                sure = {i: p for i, p in said[1 - k].items() if p >= SURE or p <= 1 - SURE}
                weight = min(ONE, SHARE * len(own) / len(sure)) if sure else 0.0
                models[k].newton([(seen[i][k], labels[i], 1.0) for i in own] + [(seen[i][k], float(p > 0.5), weight) for i, p in sure.items()])
    logit = lambda k, i: float(np.clip(models[k].z(seen[i][k]) @ models[k].beta, -30, 30))
    first, second = ([i for i in order if fold[i] == f] for f in (0, 1))
    scaled = [Plain(np.array([[logit(k, i)] for i in first]), np.array([labels[i] for i in first])) for k in (0, 1)]
    both = lambda i: np.array([float(np.clip(scaled[k].z(np.array([logit(k, i)])) @ scaled[k].beta, -30, 30)) for k in (0, 1)])
    joint = Plain(np.array([both(i) for i in second]), np.array([labels[i] for i in second]))
    for i in seen:
        want = [*sigmoid(both(i)), joint.p(both(i))]
        assert np.allclose([got[i].p_text, got[i].p_meta, got[i].quality], want, atol=1e-4), i
