"""TF-IDF cosine scores of text units against questions, adaptive cutoff and selection.

The weights of a term depend on the group (a document) and the question, which counts as one more text.
Units are weighted once without the question; a question then corrects only the terms that it shares, so
the work is an equi-join on terms and units that share nothing never meet a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.functions.text import tokens


#: Rows of question terms, about forty bytes each, up to which they are broadcast.
BROADCAST_ROWS = 200_000


def term_counts(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, tok, tf of the tokens of a text column."""
    return units.select(*keys, F.explode(tokens(F.col(text))).alias("tok")).groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("tf"))


def _idf(n: Column, df: Column) -> Column:
    return F.log((2 + n) / df) + 1


def cosines(unit_terms: DataFrame, counts: DataFrame, question_terms: DataFrame, group: list[str], unit: str) -> DataFrame:
    """group, q_id, unit, score of units that share a term with a question; others score 0.

    unit_terms: group, unit, tok, tf.  counts: group, n (number of units).  question_terms: q_id, tok, tf.
    If q_id is in group, a group only meets its own question.
    """
    on = ["q_id", "tok"] if "q_id" in group else ["tok"]
    asked = question_terms.select("q_id", "tok", F.col("tf").alias("tf_q"))
    # terms of few questions are looked up where the units lie, so a common word needs no task of its own
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    df = unit_terms.groupBy(*group, "tok").agg(F.count(F.lit(1)).alias("df")).join(counts, group)
    known = df.withColumns({"idf_0": _idf(F.col("n"), 1 + F.col("df")), "idf_q": _idf(F.col("n"), 2 + F.col("df")), "idf_new": _idf(F.col("n"), F.lit(2))})
    weighted = unit_terms.join(known, [*group, "tok"])
    base = weighted.groupBy(*group, unit).agg(F.sum(F.col("tf") ** 2 * F.col("idf_0") ** 2).alias("base"))
    pair = [*group, *([] if "q_id" in group else ["q_id"])]
    shared = weighted.join(asked, on).groupBy(*pair, unit).agg(
        F.sum(F.col("tf") * F.col("tf_q") * F.col("idf_q") ** 2).alias("dot"),
        F.sum(F.col("tf") ** 2 * (F.col("idf_q") ** 2 - F.col("idf_0") ** 2)).alias("change"),
    )
    plain = asked.groupBy("q_id").agg(F.sum(F.col("tf_q") ** 2).alias("squares"))
    lifted = known.join(asked, on).groupBy(*pair).agg(
        F.sum(F.col("tf_q") ** 2 * (F.col("idf_q") ** 2 - F.col("idf_new") ** 2)).alias("q_change"), F.first("idf_new").alias("idf_new")
    )
    norms = lifted.join(plain, "q_id").select(*pair, (F.col("squares") * F.col("idf_new") ** 2 + F.col("q_change")).alias("q_norm"))
    scored = shared.join(base, [*group, unit]).join(norms, pair)
    return scored.select(*pair, unit, F.round(F.col("dot") / F.sqrt((F.col("base") + F.col("change")) * F.col("q_norm")), 6).alias("score"))


def ranked(scores: DataFrame, counts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, q_id, n, scored (array of (score, win_id), the best ``pool``), n_scored, p40, max_score of pairs that share a term.

    Windows that share nothing score 0 and enter the percentile by their number alone.  Scores are ranked by
    a sort that can spill; only the best and the two that the percentile lies between are kept.
    """
    best_first = Window.partitionBy("doc_id", "q_id").orderBy(F.desc("score"), "win_id")
    held = scores.filter("score > 0").join(counts, "doc_id").withColumn("rank", F.row_number().over(best_first))
    place = F.lit(cfg.percentile) * (F.col("n") - 1)
    lo = F.floor(place).cast("int")
    # the i-th smallest of all is the (n - i)-th best; zeros have no row
    nth = lambda i: F.coalesce(F.max(F.when(F.col("rank") == F.col("n") - i, F.col("score"))), F.lit(0.0))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= cfg.pool, F.struct("rank", "score", "win_id"))))
    made = held.groupBy("doc_id", "q_id", "n").agg(
        F.transform(top, lambda t: F.struct(t["score"].alias("score"), t["win_id"].alias("win_id"))).alias("scored"),
        F.count(F.lit(1)).cast("int").alias("n_scored"), nth(lo).alias("below"), nth(F.least(lo + 1, F.col("n") - 1)).alias("above"), F.max("score").alias("max_score"),
    )
    p40 = F.col("below") + (F.col("above") - F.col("below")) * (place - lo)
    return made.select("doc_id", "q_id", "n", "scored", "n_scored", F.round(p40, 9).alias("p40"), "max_score")


def _in_order(limit: int) -> Column:
    """Window ids by rank, up to limit (``pool`` at most): scored ones, then those that score 0 by id."""
    ids = F.transform("scored", lambda s: s["win_id"])
    zeros = F.array_except(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.size("scored") + limit).cast("int")), ids)
    return F.slice(F.concat(ids, zeros), 1, limit)


def select_fast(best: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, q_id, ids: windows at or above the percentile, eight at most, in document order."""
    above = F.size(F.filter("scored", lambda s: s["score"] >= F.col("p40")))
    taken = F.when(F.col("p40") > 0, F.slice(F.transform("scored", lambda s: s["win_id"]), F.lit(1), F.least(above, F.lit(cfg.top_fast)))).otherwise(_in_order(cfg.top_fast))
    return best.select("doc_id", "q_id", F.array_sort(taken).alias("ids"))


def select_pool(best: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, q_id, ids: the best twenty windows whatever their score, in document order, for a reranker."""
    return best.select("doc_id", "q_id", F.array_sort(_in_order(cfg.pool)).alias("ids"))


def rerank_prune(scored: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, q_id, win_id, score) that a reranker's scores keep, with rank.

    The best is always kept; up to four whose score lies within the margin; only the best if that is
    below the floor.  Ties go to the smaller window.
    """
    w = Window.partitionBy("doc_id", "q_id")
    rows = scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "win_id")), "top": F.max("score").over(w)})
    kept = (F.col("rank") == 1) | ((F.col("rank") <= cfg.max_reranked) & (F.col("top") - F.col("score") <= cfg.rerank_margin) & (F.col("top") >= cfg.rerank_floor))
    return rows.filter(kept).select("doc_id", "q_id", "win_id", "score", "rank")
