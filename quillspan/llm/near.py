"""Near copies by the Jaccard similarity of sets of five-word shingles.

Pairs are looked for with ``BANDS`` bands of ``ROWS`` min-hashes: a pair of similarity s shares no band with
probability (1 - s**ROWS)**BANDS, 3e-6 at 0.8.  Equal sets are one node, and bands with the same members
are looked at once.  Members of a band are compared by their whole sets, so nothing below the bound is
linked; a large band is dealt out as pairs of blocks, and each block returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, checkpoint, partitions, split_join, texts_of
from quillspan.llm.components import components, named_by_least
from quillspan.llm.simhash import shingle_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5
BLOCK = 256
_rng = np.random.default_rng(20260102)
_XOR, _ODD = _rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_ODD |= np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes (uint64), sorted; none for a null or blank text."""
    return np.unique(np.array(shingle_hashes(text.encode(), size) if text else [], dtype=np.uint64))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7) if len(shingles) else 0


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """Keys (uint64) of the bands of sets that are not empty: one row a set."""
    h = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = (key ^ np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], first)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(2), 256):
                sets = [shingle_set(t, size) for t in texts]
                full = [s for s in sets if len(s)]
                keys = bands_of(full).view(np.int64).ravel() if full else np.empty(0, dtype=np.int64)
                ends = np.cumsum([0, *(BANDS * (len(s) > 0) for s in sets)]).astype(np.int32)
                nodes = np.array([node_of(s) for s in sets], dtype=np.uint64).view(np.int64)
                columns = [*(c.slice(lo, len(sets)) for c in batch.columns[:2]), pa.array(nodes), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(1), 256):
                sets = [shingle_set(t, size).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def forest(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of at least that Jaccard similarity connect: fewer than there are sets."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    places = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    left, links = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            fit = left[np.minimum(sizes[left], sizes[at]) >= similar * np.maximum(sizes[left], sizes[at])]
            if not len(fit):
                continue
            mark[places[at]] = True
            both = np.add.reduceat(mark[np.concatenate([places[x] for x in fit])].astype(np.int64), np.cumsum(sizes[fit]) - sizes[fit])
            mark[places[at]] = False
            new = fit[both >= similar * (sizes[fit] + sizes[at] - both)]
            links += [(at, x) for x in new]
            queue += new.tolist()
            left = left[~np.isin(left, new)]
    return links


def _links(similar: float):
    """Rows (key, lo, hi, node, shingles) sorted by the first three: the links of each group."""

    def solve(nodes: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        return [(nodes[a], nodes[b]) for a, b in forest([np.frombuffer(s, dtype=np.uint64) for s in sets], similar)] if len(nodes) > 1 else []

    def made(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for *key, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    found += solve(nodes, sets)
                    at, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(shingles)
            yield from made(found)
        yield from made(solve(nodes, sets))

    return run


def links(rows: DataFrame, sets: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among nodes that share a key of rows (key, node, n: the nodes with that key); sets (node, shingles)."""
    parts = F.ceil(F.col("n") / F.lit(block)).cast("long")
    met = rows.withColumns({"parts": parts, "mine": F.pmod(F.xxhash64("node"), parts)}).join(sets, "node")
    dealt = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "shingles"
    )
    group = ["key", "lo", "hi"]
    return dealt.repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group).mapInArrow(_links(similar), "a long, b long").distinct()


def near_copies(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs of that similarity) of each row of docs (doc_id, text).

    Null and blank texts are copies of one another; texts count whole, however long.  Other columns are
    ignored; no rows give no rows.  Rows without an id are linked too but do not name a
    component; if nothing in a component has an id, its component_id is null.
    """
    with Scratch(docs.sparkSession, "near") as scratch:
        texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
        prints = scratch.write(texts.mapInArrow(_prints(size), "doc_id long, text_hash long, node long, bands array<long>"))
        # which of the rows with a set stands for it does not matter
        one = F.min(F.struct("doc_id", "text_hash")).alias("one")
        kinds = scratch.write(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), one, F.first("bands").alias("bands")))
        keyed = kinds.select(F.explode("bands").alias("key"), "node")
        mark = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), mark).filter("n > 1")
        shared = scratch.write(shared.groupBy("n", "mark").agg(F.min("key").alias("key")).select("key", "n"))
        rows = scratch.write(split_join(keyed, shared, ["key"], BANDS * kinds.count()))
        wanted = kinds.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
        chosen = texts.join(wanted, (F.col("text_hash") == F.col("one_hash")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("node", "text")
        sets = scratch.write(chosen.mapInArrow(_sets(size), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))
        roots = components(links(rows, sets, similar), scratch)
        named = named_by_least(kinds.select("node", "least", "n"), roots, "node", scratch)
        return checkpoint(split_join(prints.select("doc_id", "node"), named, ["node"], prints.count()).select("doc_id", "component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Rows without an id are kept only where their whole component has none, then all of them.  Of rows
    that repeat the smallest doc_id all are kept.
    """
    chosen = near_copies(docs, size, similar).filter("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")
