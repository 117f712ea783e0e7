"""Word boxes to sentences and their pages, a batch of documents at a time.

Reading order, text, sentences and the references section of a document ask for nothing outside it.  So they are made where
its boxes lie: boxes that come as rows are shuffled once, to gather them; those that are read from a document not at all.

The definitions are those of ``layout`` and ``sentences``; a coordinate that is null is NaN here.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.config import NO_TEXT, TOO_LARGE, Settings
from quillspan.functions.text import HEADINGS, SENTENCE_END, SPACE, SPACE_CHARS
from quillspan.operators.layout import CONSENSUS, GAP_FACTOR, MIN_GUTTER, MIN_ROWS, NEAR

#: Bytes of texts, or boxes, of a batch: they bound memory, not what is read.
BYTES, BOXES = 1 << 20, 1 << 17
_END = re.compile(SENTENCE_END)
_HEADING = re.compile(rf"^{SPACE}*({HEADINGS}){SPACE}*[.:]*{SPACE}*$", re.IGNORECASE | re.ASCII)
_INLINE = re.compile(rf"(?:^|{SPACE}|\.)({HEADINGS})(?=[{SPACE_CHARS}\[\d]|$)", re.IGNORECASE | re.MULTILINE | re.ASCII)
_BOX = ("page", "seq", "x0", "y0", "x1", "y1", "word")


@dataclass
class Words:
    """Word boxes of some documents; doc: the document's place among them."""

    doc: np.ndarray
    page: np.ndarray
    seq: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    word: list[str | None]

    def take(self, at: np.ndarray) -> Words:
        return Words(*(getattr(self, c)[at] for c in ("doc", *_BOX[:-1])), [self.word[i] for i in at.tolist()])


@dataclass(frozen=True)
class Boxes:
    """Word boxes of documents (doc_id and what they are read from; one row each) in two forms.

    rows: of a table of documents, boxes(doc_id, page, seq, x0, y0, x1, y1, word).  batch: of a batch of documents.
    """

    docs: DataFrame
    rows: Callable[[DataFrame], DataFrame]
    batch: Callable[[pa.RecordBatch], Words]


def gathered(boxes: DataFrame, max_pages: int = 25) -> Boxes:
    """Boxes that come as rows."""
    held = boxes.filter(F.col("page") < max_pages).groupBy("doc_id").agg(F.collect_list(F.struct(*(F.col(c).cast(k) for c, k in zip(_BOX, ("int", "long", *["double"] * 4, "string"))))).alias("boxes"))
    return Boxes(held, lambda _: boxes, _unpacked)


def _unpacked(rows: pa.RecordBatch) -> Words:
    held = rows.column("boxes")
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False))
    fields = dict(zip(_BOX, held.flatten().flatten()))
    return Words(doc, *(fields[c].to_numpy(zero_copy_only=False) for c in _BOX[:-1]), fields["word"].to_pylist())


def _sortable(values: np.ndarray) -> np.ndarray:
    """Values in whose order nulls come first."""
    gone = np.isnan(values)
    return np.where(gone, -np.inf, values) if gone.any() else values


def _upper_medians(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Upper median of each group of values, which lie in a row; NaN without any."""
    out, lo = np.full(len(count), np.nan), 0
    for k, n in enumerate(count.tolist()):
        if n:
            out[k] = np.partition(values[lo : lo + n], n // 2)[n // 2]
        lo += n
    return out


def _row_begins(y: np.ndarray, page: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """Whether a row begins at each word, by page and y0: at a page's first, then beyond the tolerance of the row's first."""
    first = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    begins, ys = [], y.tolist()
    for at, hi, t in zip(first.tolist(), [*first[1:].tolist(), len(ys)], tol.tolist()):
        while at < hi:
            begins.append(at)
            v = ys[at]
            if v != v:  # nulls come first, and nothing is beyond them
                break
            at = bisect_right(ys, v + t, at, hi)
            # a sum is rounded otherwise than a difference
            while ys[at - 1] - v > t:
                at -= 1
            while at < hi and not ys[at] - v > t:
                at += 1
    out = np.zeros(len(y), dtype=bool)
    out[begins] = True
    return out


def _gutters(page: np.ndarray, row: np.ndarray, x0: np.ndarray, x1: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
    """Gutter of each of n pages, NaN without one.  page, row: of words, ascending."""
    order = np.lexsort((seq, _sortable(x0), row))
    left, right = x1[order[:-1]], x0[order[1:]]
    gap = np.where(row[1:] == row[:-1], right - left, np.nan)
    real = np.flatnonzero(gap > 0)
    limit = np.fmax(_upper_medians(gap[real], np.bincount(page[real], minlength=n)) * GAP_FACTOR, MIN_GUTTER)
    # the widest gap of a row, if it goes beyond the limit; of equal ones the leftmost
    wide = real[gap[real] >= limit[page[real]]]
    wide = wide[np.lexsort((-right[wide], left[wide], -gap[wide], row[wide]))]
    wide = wide[np.flatnonzero(np.diff(row[wide], prepend=-1))]
    centre, at = (left[wide] + right[wide]) / 2, page[wide]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    eligible = np.bincount(page[begin[np.diff(begin, append=len(row)) >= 2]], minlength=n)
    mid = _upper_medians(centre, np.bincount(at, minlength=n))
    near = np.abs(centre - mid[at]) <= NEAR
    centre, at = centre[near], at[near]
    order = np.lexsort((centre, at))
    agreed = np.bincount(at, minlength=n)
    mean = np.bincount(at[order], centre[order], minlength=n) / np.maximum(agreed, 1)
    return np.where((eligible >= MIN_ROWS) & (agreed > 0) & (agreed / np.maximum(eligible, 1) >= CONSENSUS), mean, np.nan)


def reading_order(words: Words) -> np.ndarray:
    """Order of words by document and page, left column first, then by y0, x0 and seq."""
    if not len(words.doc):
        return np.empty(0, dtype=np.int64)
    key = (words.doc.astype(np.int64) << 32) + words.page.astype(np.int64)
    by_page = np.argsort(key, kind="stable")
    page = np.cumsum(np.diff(key[by_page], prepend=key[by_page[0]]) != 0)
    n, height = int(page[-1]) + 1, (words.y1 - words.y0)[by_page]
    high = height > 0
    # F.greatest passes over nulls, so a page without heights has the least tolerance
    tol = np.fmax(_upper_medians(height[high], np.bincount(page[high], minlength=n)) * 0.5, 1.5)
    seq = _sortable(words.seq)
    order = by_page[np.lexsort((seq[by_page], _sortable(words.x0)[by_page], _sortable(words.y0)[by_page], page))]
    x0, y0 = words.x0[order], words.y0[order]
    row = np.cumsum(_row_begins(y0, page, tol)) - 1
    gutter = _gutters(page, row, x0, words.x1[order], seq[order], n)
    beyond = x0 >= gutter[page]
    return order[np.argsort(page * 2 + beyond, kind="stable")] if beyond.any() else order


def texts(words: Words, order: np.ndarray, n: int) -> Iterator[tuple[str, list[int], list[int]] | None]:
    """Text of each of n documents, where its pages begin and which they are, of words in an order; None without words."""
    doc, page, word = words.doc[order], words.page[order], [words.word[i] for i in order.tolist()]
    key = (doc.astype(np.int64) << 32) + page.astype(np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    full = None not in word
    size = np.fromiter(map(len, word), np.int64, len(key)) + 1 if full else np.array([0 if w is None else len(w) + 1 for w in word])
    before = np.concatenate([[0], np.cumsum(size)])[first]
    bounds, pages = [*first.tolist(), len(key)], page[first].tolist()
    of_doc = np.searchsorted(doc[first], np.arange(n + 1)).tolist()
    for lo, hi in zip(of_doc, of_doc[1:]):
        if lo == hi:
            yield None
        elif full:
            yield " ".join(word[bounds[lo] : bounds[hi]]), (before[lo:hi] - before[lo]).tolist(), pages[lo:hi]
        else:
            parts = (" ".join(w for w in word[bounds[k] : bounds[k + 1]] if w is not None) for k in range(lo, hi))
            yield " ".join(parts), (before[lo:hi] - before[lo]).tolist(), pages[lo:hi]


def split(text: str, least: int) -> tuple[list[str], list[int]]:
    """Sentences of a text and where they begin."""
    sents, starts, at = [], [], 0
    for gap in [*_END.finditer(text), None]:
        raw = text[at : gap.start()] if gap else text[at:]
        bare = raw.lstrip()
        sent = bare.rstrip()
        if len(sent) > least:
            sents.append(sent)
            starts.append(at + len(raw) - len(bare))
        if gap:
            at = gap.end()
    if sents:
        return sents, starts
    bare = text.lstrip()
    return ([bare.rstrip()], [len(text) - len(bare)]) if bare else ([NO_TEXT], [0])


def before_references(text: str, sents: list[str], starts: list[int]) -> int:
    """How many sentences come before the references section; all if none would be left."""
    for k, sent in enumerate(sents):
        if len(sent) <= 40 and _HEADING.search(sent):
            return k or len(sents)
    cut = len(text) * 3 // 5
    low = text[cut:].lower()
    found = _INLINE.search(text[cut:]) if "reference" in low or "bibliography" in low or "cited" in low else None
    k = next((k for k, at in enumerate(starts) if at >= cut + found.start(1)), 0) if found else 0
    return k or len(sents)


def _read(text: str, begins: list[int], pages: list[int], cfg: Settings) -> tuple[str | None, list[str], list[int]]:
    if 4 * len(text) > cfg.max_bytes and len(text.encode()) > cfg.max_bytes:
        return TOO_LARGE, [], []
    sents, starts = split(text, cfg.min_sentence)
    if not cfg.use_layout:
        return None, sents, [0] * len(sents)
    n = before_references(text, sents, starts)
    at = (bisect_right(begins, s) for s in starts[:n])
    return None, sents[:n], [pages[k - 1] if k else 0 for k in at]


def _shares(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    held = rows.column(1)
    size, most = (pc.list_value_length(held), BOXES) if pa.types.is_list(held.type) else (pc.binary_length(held), BYTES)
    share = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False)) // most
    begin = np.flatnonzero(np.diff(share, prepend=-1)).tolist()
    for lo, hi in zip([0, *begin[1:]], [*begin[1:], rows.num_rows]):
        yield rows.slice(lo, hi - lo)


def sentences_of(boxes: Boxes, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, error, sents, page: the sentences before the references and their pages, one row a document with words."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for rows in _shares(batch) if batch.num_rows else ():
                words = boxes_of(rows)
                early = words.page < cfg.max_pages
                words = words if early.all() else words.take(np.flatnonzero(early))
                found = list(texts(words, reading_order(words), rows.num_rows))
                some = [k for k, t in enumerate(found) if t is not None]
                error, sents, page = zip(*(_read(*found[k], cfg) for k in some)) if some else ((), (), ())
                ids = rows.column("doc_id").take(pa.array(some, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(error, pa.string()), pa.array(sents, pa.list_(pa.string())), pa.array(page, pa.list_(pa.int32()))], ["doc_id", "error", "sents", "page"])

    boxes_of = boxes.batch
    kind = boxes.docs.schema["doc_id"].dataType.simpleString()
    return boxes.docs.filter("doc_id is not null").mapInArrow(run, f"doc_id {kind}, error string, sents array<string>, page array<int>")
