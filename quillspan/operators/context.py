"""Context assembly under a budget, and the page of a place in a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.functions.text import word_count_tokens


def within_budget(ordered: DataFrame, cfg: Settings = Settings(), count=word_count_tokens) -> DataFrame:
    """Rows (doc_id, q_id, rank, window, ...) up to the first whose tokens go beyond the budget; the first always."""
    running = Window.partitionBy("doc_id", "q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("cum", F.sum(count(F.col("window"))).over(running)).filter((F.col("cum") <= cfg.token_budget) | (F.col("rank") == 1))


def chosen_windows(selected: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, q_id, rank (from 1), win_id, window, sent_offsets of the ids selected, in their order."""
    ids = selected.select("doc_id", "q_id", F.posexplode("ids").alias("pos", "win_id")).withColumn("rank", F.col("pos") + 1).drop("pos")
    return ids.join(windows, ["doc_id", "win_id"]).select("doc_id", "q_id", "rank", "win_id", "window", "sent_offsets")


def assemble(rows: DataFrame) -> DataFrame:
    """doc_id, q_id, context, window_offsets (win_idx, ctx_start, ctx_end), window_sent_offsets, by rank.

    Windows are joined by a space; text that they share is repeated.
    """
    held = rows.groupBy("doc_id", "q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "window", "sent_offsets"))).alias("parts"))
    before = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p["window"]) + 1)
    offsets = F.transform("parts", lambda p, i: F.struct(i.alias("win_idx"), before(i).alias("ctx_start"), (before(i) + F.length(p["window"])).alias("ctx_end")))
    return held.select("doc_id", "q_id", F.array_join(F.transform("parts", lambda p: p["window"]), " ").alias("context"), offsets.alias("window_offsets"), F.transform("parts", lambda p: p["sent_offsets"]).alias("window_sent_offsets"))


def _first_or_last(items: Column, holds) -> Column:
    fits = F.filter(items, holds)
    return F.when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(F.element_at(items, -1))


def page_of(char_start: Column, window_offsets: Column, window_sent_offsets: Column, pages: Column) -> Column:
    """Struct (page_number, sent_idx) of a place in a context; nulls for a negative place or no windows.

    The window that holds the place, else the last; in it the sentence that holds the place, else the
    last that begins before it, else the first.  pages: page by sentence index.
    """
    w = _first_or_last(window_offsets, lambda o: (o["ctx_start"] <= char_start) & (char_start < o["ctx_end"]))
    at = char_start - w["ctx_start"]
    sents = F.get(window_sent_offsets, w["win_idx"])
    inside, begun = F.filter(sents, lambda s: (s["ws"] <= at) & (at < s["we"])), F.filter(sents, lambda s: s["ws"] <= at)
    sent = F.coalesce(F.get(inside, F.lit(0)), F.when(F.size(begun) > 0, F.element_at(begun, -1)), F.get(sents, F.lit(0)))["sent_idx"]
    none = (char_start < 0) | (F.size(window_offsets) <= 0)
    return F.struct(F.when(~none, F.get(pages, sent)).alias("page_number"), F.when(~none, sent).alias("sent_idx"))
