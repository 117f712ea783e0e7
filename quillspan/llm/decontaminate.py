"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A test item is far smaller than most documents, so a document that holds it whole may still have a
Jaccard similarity near zero with it, and banded sketches of documents would miss it.  The sketch is
therefore one-sided.  Items are partitioned by their number n of distinct shingles, by powers of two, and
the partition says how many hits a candidate needs (``needed``).  An item's MinHash sketch is its
n - ceil(threshold * n) + needed smallest shingle hashes: a document that contains at least threshold * n
of the n shingles must contain ``needed`` of those, so no document is missed, and a shingle that many
documents share makes no candidates by itself in the partitions of larger items.  Documents are sampled by
hash: only shingles up to the largest sketch hash can meet a sketch.  Exact containment decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, checkpoint

SIZE = 5
THRESHOLD = 0.8
#: Hits in the sketch that a candidate needs, by the size partition of the item; larger ones take the last.
HITS = (1, 1, 1, 2, 2, 3)
#: Rows of a sketch table, 32 bytes each, or of item shingles, about a hundred, up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Parts that the rows of one key are dealt into where the other side is too large to be broadcast.
SALTS = 32

BLANK = "[\\x20\\x09-\\x0D]+"
_KEY = ["k", "h"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")


def shingles(ws: Column, size: int = SIZE) -> Column:
    """Word shingles of an array of words, repeats included; fewer words make one, none makes none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.concat_ws(" ", *(F.get(ws, i + j) for j in range(size))))
    return F.when(F.size(ws) >= size, runs).when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column, size: int = SIZE) -> Column:
    """Hashes of word shingles from an array of word hashes."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size))))
    return F.when(F.size(hashes) >= size, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(*(F.get(hashes, F.lit(j)) for j in range(size - 1)))))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def needed(n: Column) -> Column:
    """Hits in its sketch that an item of n shingles needs; n - ceil(threshold * n) + needed(n) never exceeds n."""
    part = F.floor(F.log2(n)).cast("int")
    return F.element_at(F.array(*map(F.lit, HITS)), F.least(part + 1, F.lit(len(HITS))))


def sketches(items: DataFrame, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """item, item_id, shingles (distinct), hits and sketch of each distinct row of items."""
    distinct = items.select(F.col("item_id").cast("long"), "text").distinct()
    held = distinct.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("ws"), word_hashes(F.col("text")).alias("wh"))
    shingled = F.array_distinct(shingles(F.col("ws"), size)).alias("shingles")
    held = held.select("item_id", "item", shingled, F.array_sort(F.array_distinct(shingle_hashes(F.col("wh"), size))).alias("hashes"))
    n = F.size("hashes")
    least = F.ceil(F.lit(threshold) * n - 1e-9).cast("int")
    held = held.filter(n > 0).withColumn("hits", F.least(needed(n), least))
    return held.select("item", "item_id", "shingles", "hits", F.slice("hashes", F.lit(1), n - least + F.col("hits")).alias("sketch"))


def _met(rows: DataFrame, others: DataFrame, on: str, n: int) -> DataFrame:
    """Inner join with n others: broadcast up to a bound, else each key is dealt into SALTS parts, and others go to all of them."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(others), on)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(SALTS)).cast("int"))
    return dealt.join(others.select("*", salts), [on, "salt"]).drop("salt")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of items held by documents.

    docs: doc_id, text; items: item_id, text.  Containment is the share of an item's distinct word
    shingles that the document has, and at least ``threshold``.  Texts are lower-cased and split at
    white space, and taken whole, however long.  A text of fewer words than ``size`` is one shingle, so a
    shorter item is found in a document of just these words.  Null or blank texts hold and match nothing.
    Each document row and each distinct item row counts for itself; a null id stays null.  Other columns
    are ignored; an empty table on either side gives no rows.
    """
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        held = scratch.write(sketches(items, threshold, size))
        sketch = held.select(F.explode("sketch").alias("hash"), "item", "hits")
        bound = sketch.agg(F.max("hash").alias("most"), F.count(F.lit(1)).alias("n")).first()
        n_shingles = held.agg(F.sum(F.size("shingles"))).first()[0] or 0
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64("text").alias("h"), "text")
        hashed = rows.select(*_KEY, word_hashes(F.col("text")).alias("wh")).select(*_KEY, F.explode(shingle_hashes(F.col("wh"), size)).alias("hash"))
        sampled = hashed.filter(F.col("hash") <= F.lit(bound["most"] if bound["n"] else -(1 << 63)))
        hits = _met(sampled, sketch, "hash", bound["n"]).groupBy(*_KEY, "item", "hits").agg(F.count_distinct("hash").alias("n"))
        candidates = scratch.write(hits.filter("n >= hits").select(*_KEY, "item"))
        few = candidates.select(*_KEY).distinct()
        few = F.broadcast(few) if candidates.count() <= BROADCAST_ROWS else few
        # words are cut in a step of their own, since each shingle reads them several times
        met = rows.join(few, _KEY).select(*_KEY, words(F.col("text")).alias("ws"))
        has = met.select(*_KEY, F.explode(F.array_distinct(shingles(F.col("ws"), size))).alias("shingle")).distinct()
        want = _met(candidates, held.select("item", F.explode("shingles").alias("shingle")), "item", n_shingles)
        shared = want.join(has, [*_KEY, "shingle"]).groupBy(*_KEY, "item").agg(F.count(F.lit(1)).alias("n_shared"))
        sizes = held.select("item", "item_id", F.size("shingles").cast("long").alias("n_shingles"))
        enough = F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)
        found = scratch.write(_met(shared, sizes, "item", n_shingles).filter(enough))
        # rows that repeat count each
        each = rows.select("doc_id", *_KEY).join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, _KEY)
        return checkpoint(each.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """Documents that hold no item; of documents with equal ids all go if one holds an item.

    Columns stay as they are, whatever their names; without items nothing goes.
    """
    hit = contained(docs, items, threshold, size).select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")


def sql(threshold: float = THRESHOLD, size: int = SIZE) -> str:
    """The same rows in DuckDB's SQL, over whole tables and without sketches."""

    def of(table: str, key: str) -> str:
        return f"""{table}_w AS (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {table}),
{table}_p AS (SELECT {key}, ws, unnest(range(greatest(len(ws) - {size} + 1, least(len(ws), 1)))) AS i FROM {table}_w),
{table}_s AS (SELECT DISTINCT {key}, array_to_string(ws[i + 1 : i + {size}], ' ') AS sh FROM {table}_p)"""

    return f"""WITH {of("benchmark", "item_id")},
{of("documents", "doc_id")},
sizes AS (SELECT item_id, count(*) AS n_shingles FROM benchmark_s GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM documents_s JOIN benchmark_s USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM met JOIN sizes USING (item_id) WHERE n_shared >= ceil({threshold} * n_shingles - 1e-9)"""
