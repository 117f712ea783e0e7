"""Sentences, their places and pages, and the references section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.config import NO_TEXT, Settings
from quillspan.functions.text import HEADINGS, SENTENCE_END, SPACE, SPACE_CHARS, lstrip, strip


def _by_doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def split_sentences(docs: DataFrame, cfg: Settings = Settings(), splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """sentences(doc_id, sent_idx, sent, char_start) of documents(doc_id, text).

    Sentences are stripped and kept if longer than ``min_sentence`` characters.  If none is left, the
    whole stripped text is one, or a fixed notice if that is empty.  ``splitter`` is a plug-in that maps
    a text to its sentences; places are then found by a forward search.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if splitter is not None:
        return _foreign(docs.select("doc_id", text.alias("text")), cfg, splitter)
    parts = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.posexplode(F.arrays_zip(F.split("text", SENTENCE_END).alias("raw"), F.regexp_extract_all("text", F.lit(SENTENCE_END), F.lit(0)).alias("gap"))).alias("pos", "p")
    )
    raw, gap = F.col("p.raw"), F.coalesce(F.length("p.gap"), F.lit(0))
    at = F.coalesce(F.sum(F.length(raw) + gap).over(_by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = parts.select("doc_id", "pos", strip(raw).alias("sent"), (at + F.length(raw) - F.length(lstrip(raw))).cast("int").alias("char_start"))
    return _or_default(docs, found.filter(F.length("sent") > cfg.min_sentence))


def _or_default(docs: DataFrame, kept: DataFrame) -> DataFrame:
    whole = docs.select("doc_id", strip(F.coalesce(F.col("text"), F.lit(""))).alias("stripped"), (F.length(F.coalesce("text", F.lit(""))) - F.length(lstrip(F.coalesce("text", F.lit(""))))).alias("lead"))
    counted = kept.select("doc_id", (F.row_number().over(_by_doc()) - 1).alias("sent_idx"), "sent", "char_start")
    default = whole.join(kept.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit(0).alias("sent_idx"), F.when(F.col("stripped") == "", NO_TEXT).otherwise(F.col("stripped")).alias("sent"), F.when(F.col("stripped") == "", 0).otherwise(F.col("lead")).cast("int").alias("char_start")
    )
    return counted.unionByName(default)


def _foreign(docs: DataFrame, cfg: Settings, splitter: Callable[[Column], Column]) -> DataFrame:
    kept = F.filter(F.transform(splitter(F.col("text")), strip), lambda s: F.length(s) > cfg.min_sentence)
    start = F.expr("named_struct('at', 1, 'out', cast(array() as array<int>))")

    def step(acc: Column, s: Column) -> Column:
        ahead = F.call_function("locate", s, F.col("text"), acc["at"])
        found = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", s, F.col("text"), F.lit(1)))
        return F.struct(F.when(found > 0, found + F.length(s)).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(found - 1)).alias("out"))

    placed = docs.select("doc_id", "text", kept.alias("sents")).withColumn("starts", F.aggregate("sents", start, step)["out"])
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("sents", "starts")).alias("pos", "s")).select("doc_id", "pos", F.col("s.sents").alias("sent"), F.col("s.starts").alias("char_start"))
    return _or_default(docs, rows)


def word_offsets(words: DataFrame) -> DataFrame:
    """words(doc_id, ord, word, ...) with char_start: the place of each word in the text joined by spaces."""
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("char_start", F.coalesce(F.sum(F.length("word") + 1).over(order), F.lit(0)).cast("int"))


def page_starts(words: DataFrame) -> DataFrame:
    """doc_id, pages: array of (start, page), by start, from words with char_start."""
    firsts = words.groupBy("doc_id", "page").agg(F.min("char_start").alias("start"))
    return firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "page"))).alias("pages"))


def sentence_pages(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Sentences with the page of the last word that begins at or before them; 0 before the first and without words."""
    joined = sentences.join(page_starts(words), "doc_id", "left")
    last = F.element_at(F.filter("pages", lambda p: p["start"] <= F.col("char_start")), -1)["page"]
    return joined.select(*sentences.columns, F.coalesce(F.when(F.size(F.filter("pages", lambda p: p["start"] <= F.col("char_start"))) > 0, last), F.lit(0)).cast("int").alias("page"))


def mark_references(docs: DataFrame, sentences: DataFrame, layout: bool = True) -> DataFrame:
    """Sentences with past_references.

    The first short sentence that is a heading begins the section; else the first heading in the last two
    fifths of the text, from the first sentence that begins at or after it.  Without page words
    (``layout`` false) marks have no effect, so none are set.
    """
    if not layout:
        return sentences.withColumn("past_references", F.lit(False))
    heading = F.col("sent").rlike(rf"(?i)^{SPACE}*({HEADINGS}){SPACE}*[.:]*{SPACE}*$") & (F.length("sent") <= 40)
    first = sentences.filter(heading).groupBy("doc_id").agg(F.min("sent_idx").alias("by_sentence"))
    pattern = rf"(?im)(?:^|{SPACE}|\.)({HEADINGS})(?=[{SPACE_CHARS}\[\d]|$)"
    cut_at = F.floor(F.lit(0.6) * F.length("text")).cast("int")
    tail = docs.select("doc_id", cut_at.alias("cut_at"), F.expr("substring(text, cast(floor(0.6 * length(text)) as int) + 1)").alias("tail"))
    at = F.regexp_instr("tail", F.lit(pattern))
    head = F.length(F.regexp_extract("tail", pattern, 0)) - F.length(F.regexp_extract("tail", pattern, 1))
    inline = tail.select("doc_id", F.when(at > 0, F.col("cut_at") + at - 1 + head).alias("heading_char"))
    marked = sentences.join(first, "doc_id", "left").join(inline, "doc_id", "left")
    by_text = F.min(F.when(F.col("char_start") >= F.col("heading_char"), F.col("sent_idx"))).over(Window.partitionBy("doc_id"))
    bound = F.coalesce("by_sentence", by_text)
    return marked.withColumn("bound", bound).select(*sentences.columns, F.coalesce(F.col("sent_idx") >= F.col("bound"), F.lit(False)).alias("past_references"))


def body(sentences: DataFrame) -> DataFrame:
    """Sentences before the references section; all of a document that has none before it."""
    any_body = F.max((~F.col("past_references")).cast("int")).over(Window.partitionBy("doc_id"))
    return sentences.withColumn("any_body", any_body).filter(~F.col("past_references") | (F.col("any_body") == 0)).drop("any_body")
