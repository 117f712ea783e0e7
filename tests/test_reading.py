"""Logits decoded in batches: no row a token or a pair in a plan, and the rows of ``decode_spans``."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import answers, reading
from quillspan.plans import catalog
from quillspan.sources import tables


def ordered(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"], r["q_id"]))


def test_pairs_are_decoded_where_their_text_lies(spark, sf_dir):
    plan = catalog.QUERIES["span_decode"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Cartesian" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("chars", [1 << 19, 700])
def test_rows_of_decode_spans(spark, monkeypatch, chars):
    monkeypatch.setattr(reading, "CHARS", chars)
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("ab \n 　é😀.") for _ in range(n))
    texts = [text(n) for n in (1, 2, 7, 8, 60, 300, 301, 2000)] + [None, "", " " * 90]
    docs = spark.createDataFrame([*enumerate(texts, 3), (None, "of no document")], "doc_id long, text string").repartition(2)
    questions = spark.createDataFrame([(q,) for q in (0, 1, 5, 44, 199, 199, None)], "q_id long")
    pairs = docs.crossJoin(questions).filter("doc_id is not null and q_id is not null").select("doc_id", "q_id", F.coalesce("text", F.lit("")).alias("context"))
    want = ordered(answers.decode_spans(tables.derived_logits(pairs)))
    assert ordered(reading.of_documents(docs, questions, tables.DERIVED)) == want and len(want) == 9 * 6
    monkeypatch.setattr(reading, "BROADCAST_ROWS", 3)
    assert ordered(reading.of_documents(docs, questions, tables.DERIVED)) == want


def test_any_logits(spark):
    """Ragged rows whose contexts lie anywhere, with ties, and one that could not be read."""
    rnd, n = np.random.default_rng(5), 70
    rows, made = [], reading.Logits(*(np.full((60, n), -np.inf, dtype=np.float32) for _ in range(2)), np.zeros(60, dtype=np.int64), np.zeros(60, dtype=np.int64), lambda row, token: (token, token + 1))
    for k in range(60):
        size = int(rnd.integers(1, n + 1))
        low, high = sorted(rnd.integers(0, size, 2).tolist()) if k else (1, 0)
        s, e = ((rnd.integers(-9, 9, size) / 4).astype(np.float32) for _ in range(2))
        made.start[k, :size], made.end[k, :size], made.low[k], made.high[k] = s, e, low, high
        rows.append((0, k, "x y" * 30, s.tolist(), e.tolist(), [int(low <= i <= high) for i in range(size)], [(i, i + 1) for i in range(size)]))
    df = spark.createDataFrame(rows, "doc_id long, q_id long, context string, start_logits array<float>, end_logits array<float>, seq_ids array<int>, offsets array<struct<s:int,e:int>>")
    got = reading.spans(lambda *a: made, np.zeros(60), np.arange(60), ["x y" * 30] * 60)
    for k, r in enumerate(ordered(answers.decode_spans(df))):
        assert got.accepted[k] == r.accepted and got.read[k] == (k > 0) == (r.best is not None)
        if k:
            assert (got.i[k], got.j[k], got.best[k], got.null_score[k], got.confidence[k]) == (r.i, r.j, r.best, r.null_score, r.confidence)
            assert (got.answer[k], got.char_start[k], got.char_end[k]) == (r.answer, r.char_start, r.char_end)
