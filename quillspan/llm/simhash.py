"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints of 64 bits are majority votes over word-shingle hashes.  Pairs within ``RADIUS`` bits are
found with 2**(RADIUS + 1) - 1 bit masks: bit b has the label (b mod 31) + 1 in {0,1}**5, and mask v
keeps the bits whose label has an odd overlap with v.  Any four differing bits leave some v != 0 with
even overlap with all their labels, so that mask keeps none of them and the pair collides there:
nothing within the radius is missed.  Equal fingerprints are one row before the masks are laid; a
large bucket is dealt out as pairs of blocks, and each block returns a spanning forest of its links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, checkpoint, partitions, split_join, texts_of
from quillspan.llm.components import components, named_by_least

RADIUS = 4
SHINGLE = 4
BLOCK = 1024
_LANE = np.uint64(0x0101010101010101)


def masks(radius: int = RADIUS) -> list[int]:
    labels = [b % (2 ** (radius + 1) - 1) + 1 for b in range(64)]
    return [sum(1 << b for b, x in enumerate(labels) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(42)))


def fingerprints_of(texts: list, size: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of texts; None counts as empty."""
    hashes, bounds = [], [0]
    for text in texts:
        if text:
            hashes += shingle_hashes(text.encode(), size)
        bounds.append(len(hashes))
    h, ends = np.array(hashes, dtype=np.uint64), np.array(bounds)
    n = np.diff(ends)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    blocks = (n[full] + 254) // 255  # so many bytes can't overflow
    first = np.cumsum(blocks) - blocks
    cuts = np.repeat(ends[full] - first * 255, blocks) + np.arange(int(blocks.sum())) * 255
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANE, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * counts > n[full][:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(axis=1, dtype=np.uint64)
    return out


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(1), 256):
                fp = fingerprints_of(texts, size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(fp)), pa.array(fp)], ["doc_id", "fp"])

    return run


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what links within the radius connect: at most one fewer than there are rows."""
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                new = left[near]
                links += [(at, x) for x in new]
                queue += new.tolist()
                left = left[~near]
    return links


def _links(radius: int):
    """Rows sorted by (mask, masked, lo, hi): the links of each group, rows of a group in one go."""

    def solve(rows: np.ndarray) -> list[tuple[int, int]]:
        fps = rows[:, 4].view(np.uint64)
        return [(rows[a, 5], rows[b, 5]) for a, b in forest(fps, radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 6), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([np.asarray(c) for c in batch.columns], axis=1)])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for group in np.split(rows, cuts)[:-1] if len(cuts) else ():
                found += solve(np.ascontiguousarray(group))
            rest = rows[cuts[-1] :] if len(cuts) else rows
            if found:
                pairs = np.array(found, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if len(rest) > 1 and (found := solve(np.ascontiguousarray(rest))):
            pairs = np.array(found, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(kinds: DataFrame, scratch: Scratch, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among rows (fp, node) with distinct fp: enough to connect all that are within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    laid = F.array(*(F.struct(F.lit(i).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked")) for i, m in enumerate(signed)))
    rows = kinds.select("fp", "node", F.explode(laid).alias("m")).select("m.*", "fp", "node")
    bucket = ["mask", "masked"]
    shared = scratch.write(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    parts = F.ceil(F.col("n") / F.lit(block)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), parts)
    met = split_join(rows, shared, bucket, len(signed) * kinds.count()).withColumns({"parts": parts, "mine": mine})
    dealt = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        *bucket, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", "node"
    )
    group = [*bucket, "lo", "hi"]
    dealt = dealt.repartition(partitions(scratch.spark), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable) of each row of docs (doc_id, text).

    Null and blank texts have the fingerprint zero and are linked like any other.  Rows with equal ids
    have a result each.  Rows without an id are linked too but do not name a component; if nothing in a
    component has an id, its component_id is null.  Texts are read whole, however long; other columns are
    ignored; no rows give no rows.
    """
    with Scratch(docs.sparkSession, "simhash") as scratch:
        prints = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_prints(size), "doc_id long, fp long"))
        kinds = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
        # a fingerprint is its own node: it is distinct, and needs no id
        roots = components(links(kinds.select("fp", F.col("fp").alias("node")), scratch, radius), scratch)
        named = named_by_least(kinds, roots, "fp", scratch)
        found = split_join(prints, named, ["fp"], prints.count())
        return checkpoint(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Rows without an id are kept only where their whole component has none, then all of them.  Of rows
    that repeat the smallest doc_id all are kept.
    """
    chosen = near_duplicates(docs, size, radius).filter("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")
