"""Reading order of word boxes: rows, the gutter between columns, and the order of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
# fixed values that results depend on
GAP_FACTOR, MIN_GUTTER, NEAR, CONSENSUS, MIN_ROWS = 4.0, 12.0, 20.0, 0.5, 3


def upper_median(c: Column) -> Column:
    held = F.sort_array(F.collect_list(c))
    return F.when(F.size(held) > 0, F.element_at(held, F.floor(F.size(held) / 2).cast("int") + 1))


def row_tolerance(words: DataFrame) -> DataFrame:
    """doc_id, page, tol: half the upper median of positive heights, 1.5 at least; 3 without any."""
    h = F.col("y1") - F.col("y0")
    return words.groupBy(*PAGE).agg(F.coalesce(F.greatest(upper_median(F.when(h > 0, h)) * 0.5, F.lit(1.5)), F.lit(3.0)).alias("tol"))


def rows(words: DataFrame) -> DataFrame:
    """Words with row_id.

    By y0, a word joins the row at hand if it lies within the tolerance of the row's first word, else it
    begins the next row; so the pass is a fold over the page, which keeps one place a row.
    """
    page = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list("y0")).alias("ys")).join(row_tolerance(words), PAGE)
    start = F.expr("cast(array() as array<double>)")

    def step(anchors: Column, y: Column) -> Column:
        return F.when((F.size(anchors) == 0) | (F.abs(y - F.element_at(anchors, -1)) > F.col("tol")), F.concat(anchors, F.array(y))).otherwise(anchors)

    # a row's words lie between its first word and that of the next row
    anchors = page.select(*PAGE, F.aggregate("ys", start, step).alias("anchors"))
    row = F.size(F.filter("anchors", lambda a: a <= F.col("y0"))) - 1
    return words.join(anchors, PAGE).withColumn("row_id", row).drop("anchors")


def gaps(with_rows: DataFrame) -> DataFrame:
    """doc_id, page, row_id, x_left, x_right, gap between neighbours of a row; null gap for a row's last word."""
    order = Window.partitionBy(*PAGE, "row_id").orderBy("x0", "seq")
    following = F.lead("x0").over(order)
    return with_rows.select(*PAGE, "row_id", "seq", F.col("x1").alias("x_left"), following.alias("x_right"), (following - F.col("x1")).alias("gap"))


def gutters(with_rows: DataFrame) -> DataFrame:
    """doc_id, page, gutter: the place between two columns on which half of the rows agree, else null."""
    between = gaps(with_rows)
    limits = between.groupBy(*PAGE).agg(F.greatest(upper_median(F.when(F.col("gap") > 0, F.col("gap"))) * GAP_FACTOR, F.lit(MIN_GUTTER)).alias("limit"), F.max("gap").alias("most")).select(*PAGE, F.when(F.col("most") > 0, F.col("limit")).alias("limit"))
    per_row = between.groupBy(*PAGE, "row_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("x_left")).alias("back"), "x_right"))).alias("w")).filter("n >= 2")
    centred = per_row.join(limits, PAGE).select(*PAGE, F.when(F.col("w.gap") >= F.col("limit"), (-F.col("w.back") + F.col("w.x_right")) / 2).alias("centre"))
    agreed = centred.groupBy(*PAGE).agg(F.count("*").alias("eligible"), upper_median(F.col("centre")).alias("mid"), F.collect_list("centre").alias("centres"))
    near = F.filter("centres", lambda c: F.abs(c - F.col("mid")) <= NEAR)
    mean = F.aggregate(F.sort_array(near), F.lit(0.0), lambda a, c: a + c) / F.size(near)
    fits = (F.col("eligible") >= MIN_ROWS) & F.col("mid").isNotNull() & (F.size(near) / F.col("eligible") >= CONSENSUS)
    found = agreed.select(*PAGE, F.when(fits, mean).alias("gutter"))
    return with_rows.select(*PAGE).distinct().join(found, PAGE, "left")


def reading_order(words: DataFrame, max_pages: int = 25) -> DataFrame:
    """Words of the first pages with ord, their place in the document: by page, left column first, then by y0 and x0."""
    words = words.filter(F.col("page") < max_pages)
    joined = words.join(gutters(rows(words)), PAGE)
    right = F.coalesce(F.col("x0") >= F.col("gutter"), F.lit(False))
    return joined.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", right, "y0", "x0", "seq")) - 1)


def page_texts(ordered: DataFrame) -> DataFrame:
    """doc_id, page, text: words joined by spaces."""
    held = ordered.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("ws"))
    return held.select(*PAGE, F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("text"))


def document_texts(ordered: DataFrame) -> DataFrame:
    """doc_id, text: pages joined by spaces."""
    held = page_texts(ordered).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"))
    return held.select("doc_id", F.array_join(F.transform("ps", lambda p: p["text"]), " ").alias("text"))
