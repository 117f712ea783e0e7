"""Scores of predicted answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import SPACE, let, strip

PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def answer_tokens(c: Column) -> Column:
    def bare(words: Column) -> Column:
        kept = F.filter(F.transform(words, lambda w: F.regexp_replace(w, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")), lambda w: w != "")
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(words))

    return let(F.filter(F.split(F.lower(strip(c)), f"{SPACE}+"), lambda w: w != ""), bare)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the multisets of tokens; equal answers score 1, or 0 if both are empty."""
    clean = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    times = lambda items, t: F.size(F.filter(items, lambda x: x == t))

    def overlap(s: Column) -> Column:
        same = F.aggregate(F.array_intersect(s["a"], s["b"]), F.lit(0), lambda n, t: n + F.least(times(s["a"], t), times(s["b"], t)))
        return let(F.struct(same.alias("same"), F.size(s["a"]).alias("na"), F.size(s["b"]).alias("nb")), ratio)

    def ratio(s: Column) -> Column:
        precision, recall = s["same"] / s["na"], s["same"] / s["nb"]
        return F.when(s["same"] == 0, 0.0).otherwise(2.0 * precision * recall / (precision + recall))

    def score(s: Column) -> Column:
        tokens = let(F.struct(answer_tokens(s["p"]).alias("a"), answer_tokens(s["g"]).alias("b")), overlap)
        return F.when(s["p"] == s["g"], F.when(s["p"] != "", 1.0).otherwise(0.0)).when((s["p"] == "") | (s["g"] == ""), 0.0).otherwise(tokens)

    return let(F.struct(clean(pred).alias("p"), clean(gold).alias("g")), score)


def item_scores(items: DataFrame) -> DataFrame:
    """items(…, gold_answer, predicted_answer, context) with retrieval_hit, exact_match, f1.

    An item with an error (a missing file, say) scores nothing but counts.
    """
    gold, pred = strip(F.coalesce("gold_answer", F.lit(""))), strip(F.coalesce("predicted_answer", F.lit("")))
    ok = F.col("error").isNull()
    hit = (gold != "") & (F.instr(F.lower(F.coalesce("context", F.lit(""))), F.lower(gold)) > 0)
    return items.withColumns({"retrieval_hit": ok & hit, "exact_match": ok & (F.lower(pred) == F.lower(gold)), "f1": F.when(ok, token_f1(F.col("predicted_answer"), F.col("gold_answer"))).otherwise(0.0)})


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Means over all items of each label, rounded to four digits."""
    mean = lambda c: F.round(F.sum(F.col(c).cast("double")) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4)
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("total_samples"), mean("retrieval_hit").alias("recall_at_5"), mean("exact_match").alias("exact_match"), mean("f1").alias("f1"))


def configurations(spark) -> DataFrame:
    """The six combinations of mode and reranker flag, with their labels."""
    modes = spark.createDataFrame([("tfidf",), ("dense",), ("hybrid",)], "retrieval_mode string")
    flags = spark.createDataFrame([(False,), (True,)], "use_reranker boolean")
    return modes.crossJoin(F.broadcast(flags)).withColumn("label", F.concat("retrieval_mode", F.when(F.col("use_reranker"), "+reranker").otherwise("")))


#: Heads of the summary table and their least widths.
MARKDOWN_COLUMNS = (("Stage", 7), ("Recall@5", 10), ("Exact Match", 13), ("F1", 6))


def markdown_lines(summaries: DataFrame, title: str) -> DataFrame:
    """place, line of a table of summaries (label, total_samples, recall_at_5, exact_match, f1), by label, under a title with the number of samples.

    Cells are padded to the longest label.  Summaries are a handful of rows, so a window over all of them is fine.
    """
    every = Window.partitionBy(F.lit(0))
    rows = summaries.withColumns({"width": F.greatest(F.max(F.length("label")).over(every) + 2, F.lit(MARKDOWN_COLUMNS[0][1])), "nth": F.row_number().over(every.orderBy("label"))})
    widths = [F.col("width"), *(F.lit(w) for _, w in MARKDOWN_COLUMNS[1:])]

    def line(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.rpad(c, w, " ") for c, w in zip(cells, widths))), F.lit(" |"))

    body = rows.select((F.col("nth") + 3).alias("place"), line([F.col("label"), *(F.format_string("%.4f", c) for c in ("recall_at_5", "exact_match", "f1"))]).alias("line"))
    head = rows.filter("nth = 1").select(
        F.posexplode(F.array(
            F.concat(F.lit(f"# {title}  ("), F.col("total_samples").cast("string"), F.lit(" samples)")), F.lit(""),
            line([F.lit(name) for name, _ in MARKDOWN_COLUMNS]), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.repeat(F.lit("-"), w) for w in widths)), F.lit(" |")),
        )).alias("place", "line")
    )
    return head.unionByName(body)


def peak(readings: DataFrame, *by: str) -> DataFrame:
    """The largest of readings(size, ...), as written, and its bytes: peak, n_bytes.  Of equal ones the later in the alphabet."""
    sized = readings.withColumn("n_bytes", size_bytes(F.col("size")))
    return sized.groupBy(*by).agg(F.max_by("size", F.struct("n_bytes", "size")).alias("peak"), F.max("n_bytes").alias("n_bytes"))


def size_bytes(c: Column) -> Column:
    """Bytes of a size such as ``234.5MiB``; 0 if it is none."""
    pattern = rf"(?i)^{SPACE}*([\d.]+){SPACE}*([KMGTPEi]*B)"
    value, unit = F.regexp_extract(c, pattern, 1), F.upper(F.regexp_extract(c, pattern, 2))
    factor = F.lit(1.0)
    for power, letter in enumerate("KMG", start=1):
        factor = F.when(unit == f"{letter}B", 1000.0**power).when(unit == f"{letter}IB", 1024.0**power).otherwise(factor)
    return F.coalesce(F.when(unit != "", value.try_cast("double") * factor), F.lit(0.0))
