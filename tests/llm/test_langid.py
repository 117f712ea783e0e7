import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm.langid import BUCKETS, Languages, fit, grams, held_out, identify

SCHEMA = "doc_id long, text string, lang string, score long"
WORDS = {"en": "the of and with shall their thing".split(), "de": "der die und nicht über schön haß".split(), "el": "και το στην είναι".split()}


def corpus(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(2, 40))), lang, 1) for i in range(n) for lang in [rnd.choice(sorted(WORDS))]]


def test_grams_do_not_cross_texts():
    texts = ["Ab c", None, "", "é1!Z", "\U0001d4d0x\U00010400"]
    together = grams(texts)
    for i, t in enumerate(texts):
        alone = grams([t])
        lo = together[2][i]
        hi = lo + len(t or "") + 2
        assert together[0][lo:hi].tolist() == alone[0].tolist() and together[1][lo:hi].tolist() == alone[1].tolist()
    assert together[3].tolist() == [3, 0, 0, 2, 3]


def test_against_brute_force_and_held_out(spark):
    rows = corpus(400, 1) + [(1000, None, "en", 0), (1001, "the of and", None, 0), (None, "the", "en", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    learn = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[1] and r[2]]
    model = fit(docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    counts = {lang: Counter() for lang in WORDS}
    for _, t, lang, _ in learn:
        h2, h3, _, _ = grams([t])
        counts[lang].update(x for x in [*h2.tolist(), *h3.tolist()] if x < BUCKETS)
    for i, lang in enumerate(model.names):
        total = sum(counts[lang].values())
        for b, n in list(counts[lang].items())[:50]:
            assert math.isclose(model.logs[b, i], math.log((n + 0.5) / (total + 0.5 * BUCKETS)), rel_tol=1e-5)
    got = identify(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    test = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang and r.text]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.98


def test_odd_texts(spark):
    model = fit(spark.createDataFrame(corpus(50, 2), SCHEMA))
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", None, 1), (3, "123 !!", None, 1), (4, "the " * 100000, None, 1), (5, "the", "xx", 1)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[5][0] == "en"
    assert identify(docs, fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert identify(docs.limit(0), model).collect() == []
    assert Languages([], np.empty(0), np.zeros((BUCKETS + 1, 0))).predict(["a"])[0] == ["und"]
    assert not spark.range(1).select(held_out(F.lit(None).cast("long")).alias("x")).first().x
