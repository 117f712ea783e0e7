"""Spans from a model's logits, a batch of contexts at a time: the definitions of ``answers.decode_spans``.

The logits of every pair are made and decoded whole, in matrices that fit a processor's cache; only the spans leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.operators.scoring import BROADCAST_ROWS

#: Characters of contexts that are read at once; it bounds memory, not what is read.  A longer context is read alone.
CHARS = 1 << 19
#: Spans in a batch of results.
ROWS = 1 << 14


@dataclass
class Logits:
    """start, end: a row of each context, padded with -inf on the right.  low, high: the first and the last token of
    the context itself, low beyond high where a row could not be read.  places(row, token): where tokens begin and end."""

    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    places: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Reader:
    """A model in both forms: ``rows`` as ``answers.read_answers`` takes it, ``logits`` of doc_ids, q_ids and contexts."""

    rows: Callable[[DataFrame], DataFrame]
    logits: Callable[[np.ndarray, np.ndarray, list[str]], Logits]

    def __call__(self, contexts: DataFrame) -> DataFrame:
        return self.rows(contexts)


@dataclass
class Spans:
    """Columns of ``decode_spans``, and read: the rows that could be read, the others' values mean nothing."""

    read: np.ndarray
    i: np.ndarray
    j: np.ndarray
    best: np.ndarray
    null_score: np.ndarray
    confidence: np.ndarray
    accepted: np.ndarray
    answer: list[str]
    char_start: np.ndarray
    char_end: np.ndarray


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    """The largest of each element of a row and the width - 1 after it, by doubling."""
    reach = 1
    while reach < min(width, values.shape[1]):
        step = min(reach, width - reach)
        wider = np.empty_like(values)
        np.maximum(values[:, :-step], values[:, step:], out=wider[:, :-step])
        wider[:, -step:] = values[:, -step:]
        values, reach = wider, reach + step
    return values


def softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax over each row, at one place of it."""
    top = logits.max(axis=1)
    work = np.subtract(logits, top[:, None], dtype=np.float64)
    np.exp(work, out=work)
    return work[np.arange(len(at)), at] / work.sum(axis=1)


def decode(m: Logits, cfg: Settings) -> tuple[np.ndarray, ...]:
    """read, i, j, best, null_score, confidence of each row."""
    read, row = m.low <= m.high, np.arange(len(m.low))
    lo, hi = (int(m.low[read].min()), int(m.high[read].max()) + 1) if read.any() else (0, 1)
    starts, ends = m.start[:, lo:hi], m.end[:, lo:hi]
    if (m.low != lo).any() or (m.high != hi - 1).any():
        at = np.arange(lo, hi)
        inside = (at >= m.low[:, None]) & (at <= m.high[:, None])
        starts, ends = np.where(inside, starts, np.float32(-np.inf)), np.where(inside, ends, np.float32(-np.inf))
    ahead = sliding_max(ends, cfg.answer_tokens)
    score = np.add(starts, ahead, dtype=np.float64)
    i = score.argmax(axis=1)
    near = np.minimum(i[:, None] + np.arange(cfg.answer_tokens), hi - lo - 1)
    j = i + (ends[row[:, None], near] == ahead[row, i][:, None]).argmax(axis=1)
    best, i, j = score[row, i], i + lo, j + lo
    null_score = m.start[:, 0].astype(np.float64) + m.end[:, 0]
    confidence = np.floor(softmax_at(m.start, i) * softmax_at(m.end, j) * 1e4 + 0.5) / 1e4
    return read, i, j, best, null_score, confidence


def spans(reader: Callable[..., Logits], doc_ids: np.ndarray, q_ids: np.ndarray, contexts: list[str], cfg: Settings = Settings()) -> Spans:
    """The best span of each context."""
    m = reader(doc_ids, q_ids, contexts)
    read, i, j, best, null_score, confidence = decode(m, cfg)
    row = np.arange(len(contexts))
    begin, end = np.array(m.places(row, i)[0]), np.array(m.places(row, j)[1])  # copies: they are changed below
    raw = [c[s:e] for c, s, e in zip(contexts, begin.tolist(), end.tolist())]
    answer = [r.strip() for r in raw]
    for k, (r, a) in enumerate(zip(raw, answer)):
        if len(r) != len(a):
            begin[k] += len(r) - len(r.lstrip())
            end[k] -= len(r) - len(r.rstrip())
    accepted = read & (best >= null_score) & (confidence >= cfg.min_confidence)
    return Spans(read, i, j, best, null_score, confidence, accepted, answer, begin, end)


def shares(sizes: np.ndarray, times: int = 1) -> Iterator[tuple[int, int]]:
    """Shares lo .. hi - 1 of items, each there ``times`` in a row, largest first, whose characters stay within the bound."""
    lo = 0
    while lo < len(sizes) * times:
        hi = min(lo + max(1, min(ROWS, CHARS // max(1, int(sizes[lo // times])))), len(sizes) * times)
        yield lo, hi
        lo = hi


SPAN = "doc_id long, q_id long, i int, j int, best double, null_score double, answer string, char_start int, char_end int, confidence double, found boolean, accepted boolean"


def of_documents(docs: DataFrame, questions: DataFrame, reader: Reader, cfg: Settings = Settings()) -> DataFrame:
    """``decode_spans`` of each document's text (doc_id, text) that is not empty, for each question (q_id)."""
    held = questions.select("q_id").filter("q_id is not null").limit(BROADCAST_ROWS + 1).toArrow()["q_id"].to_numpy()
    if len(held) > BROADCAST_ROWS:
        from quillspan.operators.answers import decode_spans

        pairs = docs.filter("doc_id is not null").crossJoin(questions.select("q_id").filter("q_id is not null"))
        return decode_spans(reader(pairs.select("doc_id", "q_id", F.coalesce("text", F.lit("")).alias("context"))), cfg)
    logits, names = reader.logits, [c.split()[0] for c in SPAN.split(", ")]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in incoming:
            ids, texts = rows.column("doc_id").to_numpy(), rows.column("text").to_pylist()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            order = np.argsort(-sizes, kind="stable")
            for lo, hi in shares(sizes[order], len(held)):
                pair = np.arange(lo, hi)
                doc, q_ids = order[pair // len(held)], held[pair % len(held)]
                s = spans(logits, ids[doc], q_ids, [texts[d] for d in doc.tolist()], cfg)
                none = ~s.read
                answer = pa.array(s.answer, pa.string(), mask=none)
                columns = [
                    pa.array(ids[doc]), pa.array(q_ids), *(pa.array(v.astype(np.int32), mask=none) for v in (s.i, s.j)), *(pa.array(v, mask=none) for v in (s.best, s.null_score)),
                    answer, *(pa.array(v.astype(np.int32), mask=none) for v in (s.char_start, s.char_end)), pa.array(s.confidence, mask=none), pa.array([a != "" for a in s.answer], pa.bool_(), mask=none), pa.array(s.accepted),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.filter("doc_id is not null and length(text) > 0").select("doc_id", "text").mapInArrow(run, SPAN)
