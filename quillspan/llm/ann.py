"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.  A hash is the
nearest signed axis of the rotated unit vector; a table's bucket is the pair of two such hashes.
Queries probe, in each table, the buckets whose axes lie next nearest.  The index holds one row for
each distinct vector with its buckets.  Queries go against it in blocks of bounded size, which are
broadcast; each task keeps the best of the rows it reads, so a crowded bucket costs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, checkpoint

TABLES = 40
#: The same for tables of every size: recall depends on probes and tables, not on the number of rows.
PROBES = 128
#: Queries in a broadcast block, on average.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of x, whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


class Hashes:
    """tables pairs of cross-polytope hashes for vectors of length dim."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = 11):
        self.width = 1 << max(0, dim - 1).bit_length()
        self.tables = tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(2 * tables, 3, self.width))
        self.axes = 2 * self.width

    def rotated(self, unit: np.ndarray, k: int) -> np.ndarray:
        x = np.pad(unit, ((0, 0), (0, self.width - unit.shape[1])))
        for signs in self.signs[k]:
            x = hadamard(x * signs)
        return x

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        out = np.zeros((len(unit), self.tables), dtype=np.int32)
        for k in range(2 * self.tables):
            y = self.rotated(unit, k)
            axis = np.abs(y).argmax(axis=1)
            out[:, k // 2] = out[:, k // 2] * self.axes + axis + self.width * (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n buckets of a table that lie nearest to each row: least total loss against the nearest axes."""
        losses, axes = [], []
        reach = min(self.axes, n)
        for k in (2 * table, 2 * table + 1):
            y = self.rotated(unit, k)
            signed = np.concatenate([y, -y], axis=1)
            order = np.argsort(-signed, axis=1, kind="stable")[:, :reach]
            near = np.take_along_axis(signed, order, axis=1)
            losses.append((near[:, :1] - near) ** 2)
            axes.append(order)
        out = np.empty((len(unit), min(n, reach * reach)), dtype=np.int32)
        for i in range(len(unit)):
            total = np.add.outer(losses[0][i], losses[1][i]).ravel()
            best = np.argpartition(total, out.shape[1] - 1)[: out.shape[1]]
            out[i] = axes[0][i][best // reach] * self.axes + axes[1][i][best % reach]
        return out


class Block:
    """Queries of one block: vectors, and for each table the queries that probe each bucket."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashes: Hashes, probes: int, keep: int):
        self.ids, self.vectors, self.keep = ids, vectors, keep
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / self.norms[:, None]
        self.probed = []
        for t in range(hashes.tables):
            found = hashes.probes(unit, t, probes)
            order = np.argsort(found, axis=None, kind="stable")
            who = (order // found.shape[1]).astype(np.int32)
            self.probed.append((*np.unique(found.ravel()[order], return_index=True), who))

    def candidates(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that meet in some table, each once."""
        seen = np.zeros((len(self.ids), len(buckets)), dtype=bool)
        for (keys, starts, who), codes in zip(self.probed, buckets.T):
            ends = np.append(starts[1:], len(who))
            at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            rows = np.flatnonzero(keys[at] == codes)
            first, n = starts[at[rows]], ends[at[rows]] - starts[at[rows]]
            places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            seen[who[places], np.repeat(rows, n)] = True
        return np.nonzero(seen)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                cls = part.column(0).to_numpy()
                rows = matrix(part.column(1))
                norms = np.sqrt((rows * rows).sum(axis=1))
                q, r = self.candidates(matrix(part.column(2)))
                score = np.empty(len(q))
                for i in range(0, len(q), 16384):
                    a, b = q[i : i + 16384], r[i : i + 16384]
                    score[i : i + 16384] = np.einsum("ij,ij->i", self.vectors[a], rows[b]) / (self.norms[a] * norms[b])
                best = self.best(*(np.concatenate(x) for x in zip(best, (q, score, cls[r]))))
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query", "cls", "score"])

    def best(self, q: np.ndarray, score: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((cls, -score, q))
        q, score, cls = q[order], score[order], cls[order]
        first = np.searchsorted(q, q, side="left")
        top = np.arange(len(q)) - first < self.keep
        return q[top], score[top], cls[top]


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    if np.issubdtype(values.dtype, np.floating):
        values = values.astype(np.float64)
    return values.reshape(len(column), -1)


def _index(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                x = matrix(part.column(2))
                codes = hashes.buckets(x / np.sqrt((x * x).sum(axis=1))[:, None])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, hashes.tables, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists, part.column(1)], ["cls", "v", "buckets", "ids"])

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) of the k nearest found rows of each query.

    vectors: vec_id, embedding (array of float or double).  queries: the same columns, a part of those
    rows.  A row is no neighbour of its own id.  Ties go to the smaller vec_id.  Rows without an id,
    and vectors that are null, empty, zero or hold null or non-finite components, take no part, nor do
    those of another length than most.  Equal vectors are one row of the index with the k + 1 smallest
    ids, which is all that can be among the k nearest.  Vectors with
    components from about 1e150 on, whose squares do not fit a double, take no part either.  An empty table on either side
    gives no rows; other columns are ignored.
    """
    with Scratch(vectors.sparkSession, "ann") as scratch:
        return _nearest(vectors, queries, k, tables, probes, block, scratch)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, block: int, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        fits = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        return df.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & (fits > 0) & (fits < float("inf"))).withColumn("v", F.transform("v", lambda x: x + 0.0))

    rows = usable(vectors)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    rows, asked = rows.filter(F.size("v") == dim), usable(queries).filter(F.size("v") == dim)
    same = Window.partitionBy("v").orderBy("vec_id")
    least = rows.distinct().withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    classes = least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "v")
    hashes = Hashes(dim, tables)
    index = scratch.write(classes.mapInArrow(_index(hashes), "cls long, v array<double>, buckets array<int>, ids array<long>"))
    wanted = scratch.write(asked.select(F.col("vec_id").alias("query_id"), "v").distinct().join(index.select("cls", "v"), "v").select("query_id", "cls"))
    probes = min(hashes.axes**2, probes)
    asked_classes = index.join(wanted.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    blocks = max(1, -(-asked_classes.count() // block))
    found = None
    for i in range(blocks):
        mine = asked_classes.filter(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == i).toPandas()
        if len(mine):
            held = spark.sparkContext.broadcast(Block(mine["cls"].to_numpy(), np.stack(mine["v"].to_numpy()), hashes, probes, k + 1))
            part = scratch.write(index.select("cls", "v", "buckets").mapInArrow(lambda it, held=held: held.value.search(it), "query long, cls long, score double"))
            found = part if found is None else found.union(part)
            held.unpersist()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    best = found.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1).drop("nth")
    spread = best.join(index.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = wanted.join(spread, wanted["cls"] == spread["query"]).filter("vec_id != query_id").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return checkpoint(pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
