"""Shared pieces of the training-data operators: scratch tables, lineage cuts and Arrow text blocks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on one machine (tests)."""
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspan-"))
    return context._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that live as long as the operator runs, however it ends.

    A written table outlives lost executors, is compressed, and can be dropped when superseded.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.turn = 0
        self.named: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = self._next()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def deal(self, df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
        """A table dealt into buckets by keys, each sorted by them: joins on these keys need no shuffle of it.

        dealt: df lies in partitions by keys already.
        """
        path, n = self._next(), partitions(self.spark)
        name = self.named[path] = f"quillspan_{uuid.uuid4().hex}"
        df = df if dealt else df.repartition(n, *keys)
        df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path = path
        return out

    def dealt(self, path: str, schema: str, keys: list[str], n: int) -> DataFrame:
        """A table that an earlier session dealt into n buckets."""
        name, by = f"quillspan_{uuid.uuid4().hex}", ", ".join(keys)
        self.named[path] = name
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
        out = self.spark.table(name)
        out._scratch_path = path
        return out

    def exists(self, path: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _next(self) -> str:
        self.turn += 1
        return f"{self.root}/{self.turn}"

    def drop(self, df: DataFrame | None = None) -> None:
        """Delete one table, or all of them, and let Spark delete shuffle files nobody can read again."""
        path = df._scratch_path if df is not None else self.root
        self.forget(None if df is None else path)
        delete(self.spark, path)
        release(self.spark)

    def forget(self, path: str | None = None) -> None:
        """Take names of dealt tables out of the catalog; their files stay."""
        for held in [p for p in self.named if path is None or p == path]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(held)}")


#: A key that more than one row in so many has is hot; fewer keys than this can be.
HOT_SHARE = 1000


def split_join(rows: DataFrame, others: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of rows with others, which have one row a key and in ``n`` the number of rows with that key.

    Of ``total`` rows, fewer than HOT_SHARE keys can be hot.  These are looked up where the rows lie, and
    only the rows of the other keys are dealt by key.  ``others`` is read twice, so it should be a table.
    """
    if total <= HOT_SHARE:
        return rows.join(others, on)
    hot = F.col(n) * HOT_SHARE > total
    found = others.filter(hot).collect()
    if not found:
        return rows.join(others, on)
    known = F.broadcast(rows.sparkSession.createDataFrame(found, others.schema))
    cold = rows.join(known.select(*on), on, "left_anti").join(others.filter(~hot), on)
    return cold.unionByName(rows.join(known, on))


_released = [0.0]


def release(spark: SparkSession, every: float = 5.0) -> None:
    """Collect garbage in the driver, upon which Spark deletes shuffle files nobody can read again; now and then is enough."""
    if time.monotonic() - _released[0] >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts of about ``most`` bytes: first row, end row, bytes, n + 1 offsets.

    Nulls are empty texts.  A longer text makes a block of its own.
    """
    column = column.cast(pa.large_string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def texts_of(column: pa.Array, rows: int = 512) -> Iterator[tuple[int, list]]:
    """Python strings of a column, some rows at a time, so that long texts do not pile up."""
    for lo in range(0, len(column), rows):
        yield lo, column.slice(lo, rows).to_pylist()
