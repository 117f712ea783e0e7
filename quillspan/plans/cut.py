"""Cuts of long plans: tables that several later steps read are materialised in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names; a local one only where none is named and all run on one machine."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspan-"))
    # a union whose sides adaptive execution gives other numbers of partitions fails where it is taken for partitioned by key
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.checkpoint(eager=True)
