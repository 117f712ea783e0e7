"""Suffix-array dedup: a logarithmic index family over content-chosen suffixes.

Documents are cut into batches.  Each batch gets a sparse suffix array: the suffixes that
``repeats_kernel.picks`` chooses, in order of the fingerprint of their first ``depth`` symbols, equal
ones merged and counted.  Arrays are dealt into buckets by fingerprint and sorted in them, so that two of
them meet in one merging scan without a shuffle.  A new array merges with levels of its own size, which
gives a level of twice the size, until it comes to an empty place; then it is merge-scanned against the
larger levels.  So the family has about log2(batches) levels and each suffix is rewritten as often.  A
family in a named folder stays there and takes further batches later.

Suffixes that are equal to the depth are then settled exactly: runs of starts with equal surroundings are
repeated as a whole, others are split into shorter runs and finally into single starts.

The order is that of 64-bit fingerprints, not of the bytes: only equality up to the depth is asked
for, and fingerprints keep text out of the levels.  Verdicts rest on 128-bit fingerprints.

Strings of two units are looked for in the same passes: of ``MATCH`` bytes, and passages of ``PASSAGE``
words, whatever their white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import repeats_kernel as kernel
from quillspan.llm.common import Scratch, checkpoint, partitions, release, split_join, text_blocks

MATCH = 400
#: Words of a passage; shorter ones are left alone.
PASSAGE = 51
BATCHES = 4
#: Lengths of the runs into which undecided runs of starts are split, in turn.
RUNS = (16, 1)
KEY = ["k", "h"]
Matches = tuple[int, int]


def _identified(docs: DataFrame) -> DataFrame:
    """A row is known by k (doc_id, -1 for null) and h (hash of its text), so equal rows, and rows without an id, have a result each."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64("text").alias("h"), "text")


# Places of both units travel together: a place times two, plus the unit.


def _suffixes(matches: Matches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, _, data, ends in text_blocks(batch.column(2)):
                for unit, match in enumerate(matches):
                    symbols, offsets = kernel.symbols(data, ends, unit)
                    doc, _, _, at = kernel.picks(symbols, offsets, match)
                    if len(doc):
                        key = kernel.Prints(symbols, (0,)).of(at, at + kernel.depth_of(match))
                        columns = (k[row + doc], h[row + doc], (at - offsets[doc]) * 2 + unit, key)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*KEY, "at", "key"])

    return run


def _split(triples: np.ndarray, most: int, match: int) -> tuple[np.ndarray, ...]:
    """First and last start, suffix and bounds of the core of the runs of at most ``most`` starts that (first, last, suffix) triples are split into."""
    first, last, pick = triples[0::3], triples[1::3], triples[2::3]
    head, n = (pick - last) // most, (pick - first) // most - (pick - last) // most + 1
    at = np.repeat(pick, n)
    part = np.repeat(head - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    lo = np.maximum(np.repeat(first, n), at - part * most - most + 1)
    hi = np.minimum(np.repeat(last, n), at - part * most)
    return lo, hi, at, at - part * most, at - part * most - most + 1 + match


def _runs(matches: Matches, most: int):
    """Runs of starts with the fingerprints of their shared core and of all their symbols.

    most: 0 for the picked suffixes listed in ``want``, else the length (a quarter of ``match`` at most) of the
    runs into which the (first start, last start, suffix) triples of ``want`` are split.  Runs are laid out backwards from
    the suffix, which lies at the same place in equal strings; the core is what all strings of a full
    run have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            want = batch.column(3)
            bounds, wanted = want.offsets.to_numpy(), want.values.to_numpy(zero_copy_only=False)
            for row, stop, data, ends in text_blocks(batch.column(2)):
                listed = wanted[bounds[row] : bounds[stop]]
                owner = np.repeat(np.arange(stop - row), bounds[row + 1 : stop + 1] - bounds[row:stop])
                for unit, match in enumerate(matches):
                    mine = listed % 2 == unit
                    if not mine.any():
                        continue
                    symbols, offsets = kernel.symbols(data, ends, unit)
                    places = listed[mine] // 2 + offsets[owner[mine]]
                    if most:
                        lo, hi, at, *core = _split(places, min(most, max(1, match // 4)), match)
                        doc = np.searchsorted(offsets, lo, side="right") - 1
                    else:
                        doc, lo, hi, at = kernel.picks(symbols, offsets, match)
                        keep = np.isin(at, places)
                        doc, lo, hi, at = doc[keep], lo[keep], hi[keep], at[keep]
                        core = (at, at + kernel.depth_of(match))
                    if len(lo):
                        prints = kernel.Prints(symbols)
                        shape = (hi - lo) + ((core[0] - lo) << 8)
                        known = (prints.of(*core), prints.of(lo, hi + match) ^ shape, prints.of(lo, hi + match, 1), k[row + doc], h[row + doc])
                        local = ((x - offsets[doc]) * 2 + unit for x in (lo, hi, at))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*known, *local)], ["core", "x1", "x2", *KEY, "lo", "hi", "at"])

    return run


class SuffixFamily:
    """Levels of sorted suffix arrays (key, n); level i holds 2**i batches.  Suffixes themselves (k, h, at, key) are kept by batch.

    folder: where the family lives; what is there already is taken up.  None for one that goes with its scratch.
    """

    def __init__(self, scratch: Scratch, matches: Matches = (MATCH, PASSAGE), folder: str | None = None):
        self.matches, self.folder = matches, folder
        self.store = Scratch(scratch.spark, "suffixes", folder) if folder else scratch
        self.levels: list[DataFrame | None] = []
        self.hits: list[DataFrame] = []
        self.suffixes: list[DataFrame] = []
        if folder:
            self._open()

    def __enter__(self) -> SuffixFamily:
        return self

    def __exit__(self, *_) -> None:
        self.store.forget()

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Take up documents (doc_id, text), dealt into batches by their id."""
        rows = _identified(docs).select(*KEY, "text").mapInArrow(_suffixes(self.matches), "k long, h long, at long, key long")
        made = self.store.write(rows.withColumn("batch", F.pmod(F.xxhash64("k"), F.lit(batches)).cast("int")), "batch")
        self.suffixes.append(made)
        for i in range(batches):
            self._merge(made.filter(F.col("batch") == i).groupBy("key").agg(F.count(F.lit(1)).alias("n")))

    def _merge(self, array: DataFrame) -> None:
        merged, old, place = self.store.deal(array, "key", dealt=True), [], 0
        while place < len(self.levels) and self.levels[place] is not None:
            old += [merged, self.levels[place]]
            merged = self.store.deal(self.scan(merged, self.levels[place], "full_outer"), "key", dealt=True)
            self.levels[place] = None
            place += 1
        self.levels += [None] * (place + 1 - len(self.levels))
        self.levels[place] = merged
        for level in self.levels[place + 1 :]:
            if level is not None:
                self.hits.append(self.store.write(self.scan(merged, level, "inner")))
        if self.folder:
            self._save()
        for table in old:
            self.store.drop(table)

    @staticmethod
    def scan(array: DataFrame, level: DataFrame, how: str) -> DataFrame:
        """One pass over two sorted arrays: key, n of both together; of the keys of either, or (inner) of those they share."""
        level = level.withColumnRenamed("n", "m").hint("merge")
        return array.join(level, "key", how).select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def repeated(self) -> DataFrame:
        """key, n of fingerprints that more than one suffix has, each once; n suffixes at least have it."""
        found = None
        for part in [level.filter("n > 1") for level in self.levels if level is not None] + self.hits:
            found = part if found is None else found.union(part)
        return found.groupBy("key").agg(F.max("n").alias("n"))

    def shed(self, *parts: str) -> None:
        """Drop tables that nothing will read again, unless the family is to stay."""
        for part in parts if not self.folder else ():
            for table in getattr(self, part):
                if table is not None:
                    self.store.drop(table)
            getattr(self, part).clear()

    def _save(self) -> None:
        held = [("level", i, x) for i, x in enumerate(self.levels) if x is not None]
        held += [(kind, i, x) for kind, xs in (("hits", self.hits), ("suffixes", self.suffixes)) for i, x in enumerate(xs)]
        rows = [(kind, i, x._scratch_path, partitions(self.store.spark), self.store.turn) for kind, i, x in held]
        made = self.store.spark.createDataFrame(rows, "kind string, place int, path string, buckets int, turn int")
        made.coalesce(1).write.mode("append").partitionBy("turn").json(f"{self.folder}/list")

    def _open(self) -> None:
        spark, path = self.store.spark, f"{self.folder}/list"
        if not self.store.exists(path):
            return
        listed = spark.read.schema("kind string, place int, path string, buckets int, turn int").json(path).toPandas()
        self.store.turn = int(listed["turn"].max())
        last = listed[listed["turn"] == self.store.turn].sort_values("place")
        for row in last.itertuples():
            if row.kind == "level":
                self.levels += [None] * (row.place + 1 - len(self.levels))
                self.levels[row.place] = self.store.dealt(row.path, "key long, n long", ["key"], row.buckets)
            else:
                schema = "key long, n long" if row.kind == "hits" else "k long, h long, at long, key long, batch int"
                table = spark.read.schema(schema).parquet(row.path)
                table._scratch_path = row.path
                (self.hits if row.kind == "hits" else self.suffixes).append(table)


def _settle(rows: DataFrame, scratch: Scratch, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Repeated runs, and one of each kind of run that shares its core with another kind."""
    shared = ["core", "x1", "x2"]
    kinds = scratch.write(rows.groupBy(*shared).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "h", "lo", "hi", "at")).alias("one")))
    size = kinds.agg(F.count(F.lit(1)), F.sum("n")).first()
    same = split_join(rows, kinds.filter("n > 1").select(*shared, "n"), shared, size[1] or 0)
    hits = scratch.write(same.select(*KEY, "lo", "hi"))
    if last:
        return hits, None
    mixed = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hits, scratch.write(split_join(kinds.drop("n"), mixed, ["core"], size[0]).select("one.*"))


def repeated_spans(rows: DataFrame, family: SuffixFamily, scratch: Scratch) -> DataFrame:
    """Strings that start anywhere else: k, h, spans.

    rows: all documents of the family as k, h, text, dealt by k and h.  spans: (lo, hi) pairs, flat, of the
    first and the last start of repeated strings, each times two plus the unit.  Rows without any are left out.
    """
    suffixes = family.suffixes[0]
    for more in family.suffixes[1:]:
        suffixes = suffixes.unionByName(more)
    repeated = scratch.write(family.repeated())
    family.shed("levels", "hits")
    listed = split_join(suffixes, repeated, ["key"], suffixes.count()).groupBy(*KEY).agg(F.collect_set("at").alias("want"))
    every, most, found = None, 0, listed
    for following in (*RUNS, None):
        met = rows.select(*KEY, "text").join(found, KEY)
        runs = scratch.write(met.mapInArrow(_runs(family.matches, most), "core long, x1 long, x2 long, k long, h long, lo long, hi long, at long"))
        hits, left = _settle(runs, scratch, following is None)
        every = hits if every is None else every.union(hits)
        scratch.drop(runs)
        family.shed("suffixes")
        if following:
            found = left.groupBy(*KEY).agg(F.flatten(F.array_sort(F.collect_set(F.array("lo", "hi", "at")))).alias("want"))
            most = following
    return every.groupBy(*KEY).agg(F.flatten(F.array_sort(F.collect_set(F.array("lo", "hi")))).alias("spans"))


def _ranges(pairs: list[int], unit: int, match: int) -> list[list[int]]:
    """Maximal covered ranges of one unit from flat pairs of starts."""
    found: list[list[int]] = []
    for lo, hi in sorted((lo // 2, hi // 2) for lo, hi in zip(pairs[0::2], pairs[1::2]) if lo % 2 == unit):
        if found and lo <= found[-1][1]:
            found[-1][1] = max(found[-1][1], hi + match)
        else:
            found.append([lo, hi + match])
    return found


def _cut(matches: Matches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (batch.column(i) for i in range(3))
            for row, stop, data, offsets in text_blocks(texts):
                kept, where = [], ([], [])
                for i in range(row, stop):
                    whole = data[offsets[i - row] : offsets[i - row + 1]]
                    pairs = spans[i].as_py() or []
                    covered = [_ranges(pairs, unit, match) for unit, match in enumerate(matches)]
                    keep, at = [], 0
                    for lo, hi in covered[kernel.BYTES]:
                        keep.append(whole[at:lo])
                        at = hi
                    kept.append(b"".join(x.tobytes() for x in (*keep, whole[at:])))
                    for out, ranges in zip(where, covered):
                        out.append([x for pair in ranges for x in pair])
                lists = (pa.array(x, pa.list_(pa.int64())) for x in where)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, stop - row), pa.array(np.diff(offsets)), *lists, pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "removed", "passages", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, match: int = MATCH, batches: int = BATCHES, passage: int = PASSAGE, folder: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Documents without the bytes of repeated strings: doc_id, n_bytes, removed, passages, kept.

    removed: (start, end) pairs of maximal byte ranges that strings of ``match`` bytes cover which start
    anywhere else, flat.  kept: the other bytes.  passages: in the same way the ranges, in words, of
    passages of ``passage`` words that start anywhere else, in whatever white space; they are reported and
    stay in kept unless removed covers them.  Null texts count as empty.  Texts shorter than ``match`` bytes
    never lose anything.  Equal rows are copies of each other.  Other columns are ignored.  No rows give no
    rows.  The memory of a task grows with the longest text.

    folder: of a family of suffix arrays that is to stay.  ``known``, the documents that earlier calls added
    to it, are held against too, and the result covers them as well.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession, "repeats") as scratch, SuffixFamily(scratch, (match, passage), folder) as family:
        family.add(docs.select("doc_id", "text"), batches)
        every = docs.select("doc_id", "text")
        if known is not None:
            every = every.unionByName(known.select("doc_id", "text"))
        rows = scratch.deal(_identified(every), *KEY)
        release(docs.sparkSession)
        spans = repeated_spans(rows, family, scratch)
        joined = rows.join(spans, KEY, "left").select("doc_id", "text", "spans")
        return checkpoint(joined.mapInArrow(_cut(family.matches), f"doc_id {kind}, n_bytes long, removed array<long>, passages array<long>, kept binary"))


def sql(match: int = MATCH, passage: int = PASSAGE) -> str:
    """The registered query's rows in DuckDB's SQL, from all strings of all documents."""
    w = 2 * match
    return f"""WITH x AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
b_at AS (SELECT r, x, unnest(range(greatest(length(x) // 2 - {match - 1}, 0))) AS s FROM x),
b_n AS (SELECT r, s, count(*) OVER (PARTITION BY key) AS n FROM (SELECT r, s, md5(substr(x, 2 * s + 1, {w})) AS key FROM b_at)),
words AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM x),
w_at AS (SELECT r, ws, unnest(range(greatest(len(ws) - {passage - 1}, 0))) AS s FROM words),
w_n AS (SELECT r, s, count(*) OVER (PARTITION BY key) AS n FROM (SELECT r, s, md5(array_to_string(ws[s + 1 : s + {passage}], ' ')) AS key FROM w_at)),
{_sql_ranges("b", match)},
{_sql_ranges("w", passage)},
gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM b_r),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM gaps JOIN x USING (r) GROUP BY r),
told AS (SELECT r, sum(hi - lo) AS n FROM w_r GROUP BY r)
SELECT doc_id, length(x.x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, x.x))) AS kept_sha256, coalesce(told.n, 0)::BIGINT AS n_passage_words
FROM x LEFT JOIN cut USING (r) LEFT JOIN told USING (r)"""


def _sql_ranges(name: str, match: int) -> str:
    """CTE name_r(r, lo, hi): maximal ranges covered by the strings of name_n that are there more than once."""
    return f"""{name}_new AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + {match}, true)::INT AS new FROM {name}_n WHERE n > 1),
{name}_r AS (SELECT r, min(s) AS lo, max(s) + {match} AS hi FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM {name}_new) GROUP BY r, g)"""
