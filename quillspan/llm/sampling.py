"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` labels of documents that are there, chosen by the hash of the id: columns of docs, label columns.

    Labels with a null id or listed more than once count once (the largest values); a document id
    that repeats gives a row for each distinct text.  The chosen ids are bounded by ``most``, so they
    are broadcast.
    """
    names = [c for c in labels.columns if c != "doc_id"]
    once = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names))
    chosen = once.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("label_id"), *names)
    return docs.select("doc_id", *columns).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", *columns, *names)
