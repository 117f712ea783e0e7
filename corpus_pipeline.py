"""Corpus pipeline: toxicity, near-dedup, benchmark decontamination, personal data, SentencePiece.

Each stage takes the documents that its predecessor kept, read again from Parquet, and returns those that it
keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, near, pieces, pii, simhash, toxicity
from quillspan.llm.common import Scratch, checkpoint, delete, shared_dir, table
from quillspan.llm.components import components
from quillspan.plans.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Near copies are those that SimHash links (fingerprints 4 bits apart at most, as in op4) and those of a
    Jaccard similarity of five-word shingles from 0.8, which fingerprints alone mostly miss; a group is what
    links of both kinds connect.
    """
    ship(spark)
    return keep_linked(docs, [simhash.near_duplicates(docs), near.near_copies(docs)])


def keep_linked(docs: DataFrame, groupings: list[DataFrame]) -> DataFrame:
    """The document with the smallest doc_id of each group that groupings (doc_id, component_id) connect together.

    Rows without an id are kept only where no grouping puts all of them with a document that has one.
    """
    with Scratch(docs.sparkSession, "linked") as scratch:
        named = [g.select("doc_id", "component_id") for g in groupings]
        edges = reduce(DataFrame.union, named).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        gone = components(edges, scratch).filter("node <> root").select(F.col("node").alias("doc_id"))
        for g in named:
            gone = gone.union(g.filter("doc_id is null").groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("component_id").isNull()).alias("apart")).filter("n > 0 and apart = 0").select(F.lit(None).cast("long")))
        gone = checkpoint(gone.distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def drop_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows the text."""
    ship(spark)
    return pii.mask(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids of the pieces, and the text decoded from them."""
    ship(spark)
    return pieces.encode(docs, pieces.Vocabulary.load(), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_passages),
    ("pii", mask_personal_data),
    ("pieces", encode_pieces),
]

#: SQL cannot express the fitted models and the encoding; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again; the last one's rows.

    A stage's table goes once the next one is written; if a stage fails, nothing is left behind.  Only the
    last table stays, for the rows that are returned.
    """
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for nth, (name, stage) in enumerate(STAGES):
            path = f"{root}/{nth}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    except BaseException:
        delete(spark, root)
        raise
    return docs
