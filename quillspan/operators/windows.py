"""Overlapping windows of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.config import Settings


def build_windows(sentences: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """windows(doc_id, win_id, window, sent_offsets) of sentences(doc_id, sent_idx, sent).

    Windows of three sentences begin at every second one; a last one is added where the end is not
    reached.  Fewer than three sentences make one window each.  sent_offsets has (sent_idx, ws, we), the
    place of each sentence in the window.
    """
    size, stride = cfg.window, cfg.stride
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    n, k = F.count(F.lit(1)).over(Window.partitionBy("doc_id")), F.row_number().over(order) - 1
    rows = sentences.select("doc_id", "sent_idx", "sent", n.alias("n"), k.alias("k"))
    ahead = [F.lead(F.struct("sent_idx", "sent"), j).over(order) for j in range(size)]
    rows = rows.withColumn("parts", F.filter(F.array(*ahead), lambda s: s.isNotNull()))
    last = F.col("n") - size
    starts = ((F.col("n") < size)) | ((F.col("k") <= last) & ((F.col("k") % stride == 0) | (F.col("k") == last)))
    rows = rows.filter(starts).withColumn("parts", F.when(F.col("n") < size, F.slice("parts", 1, 1)).otherwise(F.col("parts")))
    win_id = (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).alias("win_id")
    texts = F.transform("parts", lambda p: p["sent"])
    before = lambda i: F.aggregate(F.slice(texts, F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t) + 1)
    offsets = F.transform("parts", lambda p, i: F.struct(p["sent_idx"].alias("sent_idx"), before(i).alias("ws"), (before(i) + F.length(p["sent"])).alias("we")))
    return rows.select("doc_id", win_id, F.array_join(texts, " ").alias("window"), offsets.alias("sent_offsets"))
