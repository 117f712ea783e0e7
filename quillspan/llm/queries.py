"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import ann, decontaminate, langid, pieces, pii, quality, repeats, toxicity, urls
from quillspan.llm.common import table
from quillspan.llm.simhash import near_duplicates


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return urls.judge(pages, urls.mine(pages, labels))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    every = lambda c, bit: F.aggregate(F.filter(c, lambda x, i: i % 2 == bit), F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda c: every(c, 1) - every(c, 0)
    return cut.select(
        "doc_id",
        "n_bytes",
        size("removed").alias("n_removed"),
        F.floor(F.size("removed") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        size("passages").alias("n_passage_words"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages, labels = (table(spark, sf_dir, name) for name in ("documents", "pages", "labels"))
    return quality.rated(docs, pages, labels)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("was"))
    coded = pieces.encode(docs, pieces.Vocabulary.load(), decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), (F.xxhash64("text") == F.col("was")).alias("round_trip"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_urls": op2_urls,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_pieces": op10_pieces,
}
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": repeats.sql(), "op5_decontaminate": decontaminate.sql()}
