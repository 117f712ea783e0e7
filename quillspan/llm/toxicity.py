"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(x . w - b_k) with one weight vector w for all thresholds b_1 < b_2 < ..., fitted
by proximal gradient steps with an L1 penalty.  Features are the presence of a word, and of its first
four and first five characters, so that inflected forms share weight; they are hashed to 2**20 places,
and executors send the driver only the places that occur in each sampled document.  The expected severity is the sum
of P(grade > k) over the thresholds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import texts_of
from quillspan.llm.sampling import labelled_sample

#: Labelled documents that the model is fitted on, at most.
MAX_TRAIN = 12_000
FEATURES = 4096
GRADES = 3
PLACES = 1 << 20
WORD = re.compile(r"\w+")
_CACHE = 100_000


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % PLACES


def word_features(word: str) -> list[int]:
    """Places of a word and of its beginnings; the word's own comes first."""
    return [place("=" + word)] + [place(f"{n}{word[:n]}") for n in (4, 5) if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the words, and of all features."""
    found = [word_features(w) for w in words_of(text)]
    return np.unique(np.array([f[0] for f in found], dtype=np.int32)), np.unique(np.array([x for f in found for x in f], dtype=np.int32))


def grades_of(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Ordered grades from a binary label: 0 for clean; toxic ones are split at their median density of words that mark the toxic class."""
    n = np.zeros((2, PLACES), dtype=np.int32)
    for w, t in zip(words, toxic):
        n[int(t), w] += 1
    share = [max(1, int((toxic == t).sum())) for t in (0, 1)]
    marks = (n[1] >= 3) & (n[0] / share[0] < 0.1 * n[1] / share[1])
    density = np.array([marks[w].sum() / max(1, len(w)) for w in words])
    grade = np.zeros(len(words), dtype=np.int64)
    ill = np.flatnonzero(toxic == 1)
    if len(ill):
        grade[ill] = 1 + (density[ill] > np.median(density[ill]))
    return grade


class Ordinal:
    """A fitted model: weights by place, thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float], cut: float = 0.5):
        self.weights, self.thresholds, self.cut = weights, thresholds, cut
        self.cache: dict[str, bool] = {}

    @staticmethod
    def fit(found: list[np.ndarray], grade: np.ndarray, n_grades: int = GRADES, n_features: int = FEATURES, steps: int = 600, l1: float = 5e-5) -> Ordinal:
        n = len(found)
        if not n or grade.min() == grade.max():
            all_above = [(-1.0 if n and grade[0] > k else 1.0) * 30.0 for k in range(n_grades - 1)]
            return Ordinal({}, all_above)
        above = grade > 0
        n1 = int(above.sum())
        sizes = np.array([len(f) for f in found])
        flat = np.concatenate(found)
        a = np.bincount(flat[np.repeat(above, sizes)], minlength=PLACES).astype(float)
        b = np.bincount(flat[np.repeat(~above, sizes)], minlength=PLACES).astype(float)
        c, d = n1 - a, n - n1 - b
        chi2 = n * (a * d - b * c) ** 2 / np.maximum(1e-9, (a + b) * (c + d) * (a + c) * (b + d))
        chi2[a + b < 3] = -1.0
        chosen = np.argsort(-chi2, kind="stable")[:n_features]
        chosen = chosen[chi2[chosen] > 0]
        column = np.full(PLACES, -1, dtype=np.int64)
        column[chosen] = np.arange(len(chosen))
        cols = column[flat]
        rows = np.repeat(np.arange(n), sizes)[cols >= 0]
        cols = cols[cols >= 0]
        targets = (grade[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
        rates = np.clip(targets.mean(axis=0), 1e-3, 1 - 1e-3)
        bounds = np.log(1 / rates - 1)
        w = np.zeros(len(chosen))
        seen_w, seen_b, t = w.copy(), bounds.copy(), 1.0
        # steps from the curvature of both blocks: the largest eigenvalue of the features' squares, by power iteration
        v = np.random.default_rng(5).random(len(w)) + 0.1
        largest = 1.0
        for _ in range(30 if len(rows) else 0):
            v = np.bincount(cols, np.bincount(rows, v[cols], minlength=n)[rows], minlength=len(w)) / n
            largest = float(np.linalg.norm(v))
            v /= largest
        step, step_b = 1 / (0.55 * (n_grades - 1) * max(largest, 1e-9)), 1 / 0.55
        for _ in range(steps):  # accelerated proximal gradient, begun anew where it overshoots
            score = np.bincount(rows, seen_w[cols], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(score[:, None] - seen_b[None, :], -40, 40)))
            slope = (p - targets) / n
            new_w = seen_w - step * np.bincount(cols, slope.sum(axis=1)[rows], minlength=len(w))
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
            new_b = np.maximum.accumulate(seen_b + step_b * slope.sum(axis=0))
            if (seen_w - new_w) @ (new_w - w) / step + (seen_b - new_b) @ (new_b - bounds) / step_b > 0:
                t = 1.0
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            seen_w = new_w + (t - 1) / t_new * (new_w - w)
            seen_b = np.maximum.accumulate(new_b + (t - 1) / t_new * (new_b - bounds))
            w, bounds, t = new_w, new_b, t_new
        return Ordinal({int(f): float(x) for f, x in zip(chosen, w) if x}, [float(b) for b in bounds])

    def counts(self, word: str) -> bool:
        if word not in self.cache:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[word] = any(f in self.weights for f in word_features(word))
        return self.cache[word]

    def score(self, text: str | None) -> float:
        """x . w: each feature counts once, however many words have it."""
        hot = [w for w in words_of(text) if self.counts(w)]
        return sum(self.weights.get(f, 0.0) for f in sorted({f for w in hot for f in word_features(w)}))

    def best_cut(self, found: list[np.ndarray], toxic: np.ndarray) -> float:
        """The bound on P(grade > 0) with the fewest errors on rows that the model has not seen; 0.5 in doubt."""
        if not len(found) or toxic.min() == toxic.max():
            return 0.5
        p = self.severity(np.array([sum(self.weights.get(x, 0.0) for x in f.tolist()) for f in found]))[1]
        return min((int(((p >= c) != toxic).sum()), abs(c - 0.5), c) for c in np.arange(1, 19) / 20)[2]

    def severity(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and P(grade > 0)."""
        p = 1 / (1 + np.exp(-np.clip(scores[:, None] - np.array(self.thresholds)[None, :], -40, 40)))
        return p.sum(axis=1), p[:, 0]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Ordinal:
    """Fit on at most ``max_train`` labelled documents; a document is toxic where its label says 1.

    A quarter of them is held out at first, to choose the cut between toxic and clean.
    """
    rows = labelled_sample(docs, labels.filter(F.col("toxic").isNotNull()).select("doc_id", "toxic"), ["text"], max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(1)):
                found = [features(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(texts)) for c in (batch.column(0), batch.column(2))), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], ["id", "toxic", "words", "places"])

    made = rows.select(F.xxhash64("doc_id", "text"), "text", F.col("toxic").cast("int")).mapInArrow(run, "id long, toxic int, words binary, places binary")
    sample = made.toPandas().drop_duplicates("places").sort_values(["id"], kind="stable")
    words, places = ([np.frombuffer(x, dtype=np.int32) for x in sample[c]] for c in ("words", "places"))
    grade = grades_of(words, sample["toxic"].to_numpy().astype(int))
    held = np.arange(len(grade)) % 4 == 0
    model = Ordinal.fit([p for p, h in zip(places, held) if not h], grade[~held])
    cut = model.best_cut([p for p, h in zip(places, held) if h], grade[held] > 0)
    model = Ordinal.fit(places, grade)
    model.cut = cut
    return model


def _score(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(1)):
                scores = np.array([model.score(t) for t in texts])
                severity, p = model.severity(scores)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(severity), pa.array(p), pa.array(p >= model.cut)], ["doc_id", "expected_severity", "p_toxic", "toxic"])

    return run


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_severity (0 to 2), p_toxic, toxic (p_toxic at or above the model's cut) of each row of docs.

    A null or empty text has no features and gets what the thresholds alone say.  Texts count whole, however
    long; equal texts get equal grades.  If there were no labels, or all alike, every row gets that one label.
    Other columns are ignored; no rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, expected_severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of docs whose text is not toxic, all columns unchanged, whatever their names; rows that repeat stay or go together."""
    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(place)):
                _, p = model.severity(np.array([model.score(t) for t in texts]))
                yield batch.slice(lo, len(texts)).filter(pa.array(p < model.cut))

    return docs.mapInArrow(run, schema)
