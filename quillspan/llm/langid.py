"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else is a space.  Bigrams and trigrams of each document, with a
space around it, are hashed to ``BUCKETS`` buckets.  Counts by language come from all learning rows,
summed per task before they are shuffled; the matrix of log-probabilities is languages x buckets and is
broadcast; documents are scored many at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import texts_of

BITS = 16
BUCKETS = 1 << BITS
UNKNOWN = "und"
_SPACE = 32
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point the lower-case letter, or a space."""
    if not _letters:
        table = np.full(0x110000, _SPACE, dtype=np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams at each place, first and end place of each text, letters in each text.

    Places that hold only spaces, or reach beyond the text, have the bucket ``BUCKETS``.
    """
    joined = "".join(f" {t or ''} " for t in texts)
    c = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    sizes = np.array([len(t or "") + 2 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    blank = c == _SPACE
    n = len(c)
    h2 = np.full(n, BUCKETS, dtype=np.int32)
    h3 = h2.copy()
    pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    h2[:-1] = np.where(blank[:-1] & blank[1:], BUCKETS, ((pair ^ (pair >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    three = pair[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1) + np.uint32(0x61C88647)
    h3[:-2] = np.where(blank[:-2] & blank[1:-1], BUCKETS, ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    h2[ends - 1] = BUCKETS
    h3[ends - 1] = BUCKETS
    h3[ends - 2] = BUCKETS
    return h2, h3, starts, np.add.reduceat((~blank).astype(np.int64), starts)


def _blocks(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > most:
            yield lo, i
            lo, size = i, 0
        size += len(t or "") + 2
    if texts:
        yield lo, len(texts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in texts_of(batch.column(1)):
            by: dict[str, list] = {}
            for lang, t in zip(langs[first : first + len(texts)], texts):
                by.setdefault(lang, []).append(t)
            for lang, mine in by.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                for lo, hi in _blocks(mine):
                    h2, h3, _, _ = grams(mine[lo:hi])
                    total += np.bincount(h2, minlength=BUCKETS + 1) + np.bincount(h3, minlength=BUCKETS + 1)
                    total[BUCKETS] = 0
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])


class Languages:
    """Names, log-prior and the matrix (buckets + 1, languages) of log-probabilities; the last row is zero."""

    def __init__(self, names: list[str], prior: np.ndarray, logs: np.ndarray):
        self.names, self.prior, self.logs = names, prior, logs

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return out, score
        for lo, hi in _blocks(texts):
            h2, h3, starts, n_letters = grams(texts[lo:hi])
            total = np.add.reduceat(self.logs[h2] + self.logs[h3], starts, axis=0, dtype=np.float64) + self.prior
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i in np.flatnonzero(n_letters):
                out[lo + i], score[lo + i] = self.names[best[i]], p[i]
        return out, score


def fit(docs: DataFrame, smoothing: float = 0.5) -> Languages:
    """Learn from all rows of docs (text, lang) that have both."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    found = rows.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)))
    for i, name in enumerate(names):
        mine = found[found["lang"] == name]
        counts[mine["bucket"].to_numpy(), i] = mine["n"].to_numpy()
    logs = np.zeros((BUCKETS + 1, len(names)), dtype=np.float32)
    logs[:-1] = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * BUCKETS))
    prior = np.log(np.array([sizes[x] for x in names], dtype=float) / max(1, sum(sizes.values())))
    return Languages(names, prior, logs)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder 1; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """All columns of docs with lang_pred and score.

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or nothing was learned.
    The score is the posterior probability.  Ties go to the first language in order of name.  The whole
    text counts; equal texts get equal predictions.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(place)):
                pred, score = held.value.predict(texts)
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")
