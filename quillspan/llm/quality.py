"""Quality classifier by co-training.

One view is the text: statistics of characters, words and lines.  The other is metadata: source, language,
length and, where there is a page with the document's id, its URL and size.  Each view has a logistic
regression, first fitted on labelled documents.  Over several rounds each view labels the pool, which is
every document outside the labelled sample, where it is sure; the other view learns from these labels
and its own.  A round's labels stay while the learning views take a few Newton steps, each of which is one
pass over the pool that returns sums; so the pool has no bound and never leaves the executors.  On a fold
that no view has learned from, each view is calibrated; on another one the calibrated views are combined
by a third logistic regression, which scores all documents.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, checkpoint, texts_of
from quillspan.llm.sampling import labelled_sample

#: Labelled documents that the classifiers are fitted on, at most.
MAX_TRAIN = 8_000
ROUNDS, STEPS = 3, 2
#: A pool document is labelled by a view that gives it a probability so near 0 or 1.
SURE = 0.95
#: Weight of all labels from the other view against that of the labelled documents, at most; and of one of them.
SHARE, ONE = 0.5, 0.3
#: Rows of sums that come to the driver in each step.
SUMS = 16
META = 64
TEXT = 16
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def text_view(text: str | None) -> list[float]:
    """Statistics of a whole text; of an empty one, zeros."""
    if not text or text.isspace():
        return [0.0] * TEXT
    raw = text.encode()
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    m = len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = hist[hist > 0] / n
    return [
        np.log(n),
        np.log(m),
        hist[65:91].sum() / n,
        hist[48:58].sum() / n,
        hist[_PUNCTUATION].sum() / n,
        (hist[32] + hist[9:14].sum()) / n,
        hist[128:].sum() / n,
        n / m,
        len(counts) / m,
        max(counts.values()) / m,
        sum(map(eq, words, words[1:])) / m,
        len(set(lines)) / max(1, len(lines)),
        float(-(share * np.log(share)).sum()),
        (hist[33] + hist[35] + hist[36] + hist[37] + hist[38] + hist[42]) / m,
        hist[46] / m,
        len(lines) / m,
    ]


def meta_view(source: str | None, lang: str | None, n_chars: int | None, url: str | None, html: int | None) -> list[float]:
    """Hashed metadata: one place for each value, sizes by powers of two."""
    out = [0.0] * META
    host = (url or "").partition("://")[2].partition("/")[0]
    size = lambda n: "none" if n is None else str(max(0, n).bit_length())
    for value in (f"source={source}", f"lang={lang}", f"chars={size(n_chars)}", f"html={size(html)}", f"host={host}", f"top={host.rpartition('.')[2]}"):
        out[zlib.crc32(value.encode()) % META] += 1.0
    return out


class Logistic:
    """Standardised, ridge-penalised logistic regression fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.penalty = np.full(x.shape[1] + 1, ridge)
        self.penalty[-1] = 1e-6
        self.beta = np.zeros(x.shape[1] + 1)
        self.fixed = not len(x) or y.min() == y.max()
        if self.fixed:
            self.beta[-1] = 0.0 if not len(x) else 8.0 * (2 * y[0] - 1)
            return
        for _ in range(25):
            if self.step(*self.sums(x, y)) < 1e-8:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.hstack([z, np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature of the loss at the present weights, without the penalty."""
        z, p = self.design(x), self.probability(x)
        return z.T @ (p - y), (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z

    def step(self, slope: np.ndarray, curvature: np.ndarray) -> float:
        """One Newton step; how far it went."""
        by = np.linalg.solve(curvature + np.diag(self.penalty), slope + self.penalty * self.beta)
        self.beta -= np.clip(by, -5, 5)
        return float(np.abs(by).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.beta, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


Views = tuple[np.ndarray, np.ndarray]


def taught(views: Views, teachers: list[Logistic], learners: list[Logistic], sure: float) -> list[np.ndarray]:
    """For each learner, what the other view's sure labels of pool documents add up to: number, slope and curvature, flat."""
    out = []
    for k in (0, 1):
        p = teachers[1 - k].probability(views[1 - k])
        some = (p >= sure) | (p <= 1 - sure)
        slope, curvature = learners[k].sums(views[k][some], (p[some] > 0.5).astype(float))
        out.append(np.concatenate([[some.sum()], slope, curvature.ravel()]))
    return out


class CoTrained:
    """Both views, their calibration and their combination."""

    def __init__(self, views: Views, y: np.ndarray, pool: Callable[[Callable[[Views], list[np.ndarray]]], list[np.ndarray]], rounds: int = ROUNDS, steps: int = STEPS, sure: float = SURE):
        """pool: maps a function over blocks of the pool's views and adds up what it returns."""
        fold = np.arange(len(y)) % 10
        own = [(v[fold > 1], y[fold > 1]) for v in views]
        self.exchanged = 0
        self.views = [Logistic(*x) for x in own]
        for _ in range(rounds if not any(v.fixed for v in self.views) else 0):
            teachers = copy.deepcopy(self.views)
            for _ in range(steps):
                learners = self.views
                found = pool(lambda block, t=teachers, l=learners: taught(block, t, l, sure))
                for learner, (x, labels), flat in zip(learners, own, found):
                    n, width = float(flat[0]), len(learner.beta)
                    slope, curvature = learner.sums(x, labels)
                    weight = min(ONE, SHARE * len(labels) / n) if n else 0.0
                    learner.step(slope + weight * flat[1 : 1 + width], curvature + weight * flat[1 + width :].reshape(width, width))
            self.exchanged += int(sum(flat[0] for flat in found))
        self.calibrated = [Logistic(self.views[k].logit(views[k][fold == 0])[:, None], y[fold == 0]) for k in (0, 1)]
        self.combined = Logistic(self._both(tuple(v[fold == 1] for v in views)), y[fold == 1])

    def _both(self, views: Views) -> np.ndarray:
        return np.stack([self.calibrated[k].logit(self.views[k].logit(views[k])[:, None]) for k in (0, 1)], axis=1)

    def score(self, views: Views) -> np.ndarray:
        """Columns: calibrated probability of each view, and of both."""
        both = self._both(views)
        return np.column_stack([1 / (1 + np.exp(-both)), self.combined.probability(both)])


def viewed(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, x (text view) and meta (metadata view) of each row of docs.

    Texts are turned into their statistics before anything is shuffled.  A page id that repeats counts
    once (the smallest URL and largest page).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), "text")

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(4)):
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([text_view(t) for t in texts], pa.list_(pa.float32()))], ["doc_id", "source", "lang", "n_chars", "x"])

    def of_meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metas = [meta_view(*m) for m in zip(*(batch.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(metas, pa.list_(pa.float32()))], ["doc_id", "x", "meta"])

    made = rows.mapInArrow(of_text, "doc_id long, source string, lang string, n_chars long, x array<float>")
    once = pages.filter(F.col("page_id").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min("url").alias("url"), F.max(F.length("html").cast("long")).alias("html"))
    both = made.join(once, made["doc_id"] == once["page_id"], "left").select("doc_id", "x", "source", "lang", "n_chars", "url", "html")
    return both.mapInArrow(of_meta, "doc_id long, x array<float>, meta array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _views(batch: pa.RecordBatch) -> Views:
    """Of a batch whose last two columns are x and meta."""
    return _matrix(batch.column(batch.num_columns - 2), TEXT), _matrix(batch.column(batch.num_columns - 1), META)


def _summed(pool: DataFrame):
    """Adds up, over the pool's rows (x, meta), what a function returns for blocks of them."""
    schema = "a array<double>, b array<double>"

    def table(sums: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in sums], ["a", "b"])

    def over(work: Callable[[Views], list[np.ndarray]]) -> list[np.ndarray]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                found = work(_views(batch))
                total = found if total is None else [a + b for a, b in zip(total, found)]
            yield from table(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    found = [np.array(x) for x in row]
                    total = found if total is None else [a + b for a, b in zip(total, found)]
            yield from table(total)

        rows = pool.select("x", "meta").mapInArrow(each, schema).repartition(SUMS).mapInArrow(add, schema).collect()
        if not rows:
            return [np.zeros(1 + w + w * w) for w in (TEXT + 1, META + 1)]
        return [np.sum([r[i] for r in rows], axis=0) for i in (0, 1)]

    return over


def fit(seen: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> CoTrained:
    """Fit on viewed documents, of which at most ``max_train`` with a quality of 0 or 1 teach by their label, and all others are the pool.

    A document id with several labels has the largest.  ``seen`` is read in every step, so it should be a table.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    train = labelled_sample(seen, known, ["x", "meta"], max_train).orderBy(F.xxhash64("doc_id"), "doc_id", "x").toPandas()
    chosen = seen.sparkSession.createDataFrame([(int(i),) for i in sorted(set(train["doc_id"]))], "id long")
    pool = seen.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left_anti")
    views = tuple(np.array(train[c].tolist(), dtype=float).reshape(-1, width) for c, width in (("x", TEXT), ("meta", META)))
    return CoTrained(views, train["quality"].to_numpy(dtype=float), _summed(pool))


def assess(seen: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_text, p_meta, quality (probability of good, from both views), keep (quality >= 0.5) of each viewed row.

    A null or empty text has a text view of zeros; null metadata are values of their own.  Texts count whole,
    however long.  Equal rows have equal results, other columns of docs are ignored, no rows give no rows.
    Without labels everything has the quality 0.5 and is kept; with labels of one kind, theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = model.score(_views(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 2] >= 0.5)], ["doc_id", "p_text", "p_meta", "quality", "keep"])

    return seen.mapInArrow(run, "doc_id long, p_text double, p_meta double, quality double, keep boolean")


def rated(docs: DataFrame, pages: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The assessment of all docs (doc_id, text, source, lang, n_chars) by views that are made once."""
    with Scratch(docs.sparkSession, "quality") as scratch:
        seen = scratch.write(viewed(docs, pages))
        return checkpoint(assess(seen, fit(seen, labels, max_train)))
