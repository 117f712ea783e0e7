"""Answers as spans of their context: from model logits, or the best sentence by TF-IDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.functions.text import LOOSE_END, let, lstrip, rstrip, strip
from quillspan.operators.scoring import cosines, term_counts


def fallback_answers(contexts: DataFrame, question_terms: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, q_id, answer, char_start, char_end, confidence, found from contexts(doc_id, q_id, context).

    The sentence of the context that is nearest to the question, the first if none shares a term.  Without
    any term in question and context, the first 120 characters with confidence 0.5.
    """
    kept = F.filter(F.transform(F.split("context", LOOSE_END), strip), lambda s: F.length(s) > cfg.min_answer_sentence)
    held = contexts.select("doc_id", "q_id", "context", let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array("context"))).alias("sents"))
    units = held.select("doc_id", "q_id", F.posexplode("sents").alias("pos", "sent"))
    terms = term_counts(units, ["doc_id", "q_id", "pos"], "sent")
    counts = held.select("doc_id", "q_id", F.size("sents").alias("n"))
    scores = cosines(terms, counts, question_terms, ["doc_id", "q_id"], "pos")
    best = scores.groupBy("doc_id", "q_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("b")).select("doc_id", "q_id", F.col("b.score").alias("score"), (-F.col("b.back")).alias("pos"))
    any_terms = terms.select("doc_id", "q_id").distinct().withColumn("has_terms", F.lit(True))
    asked = question_terms.select("q_id").distinct().withColumn("asks", F.lit(True))
    joined = held.join(best, ["doc_id", "q_id"], "left").join(any_terms, ["doc_id", "q_id"], "left").join(asked, "q_id", "left")
    sent = F.get("sents", F.coalesce("pos", F.lit(0)))
    failed = F.col("has_terms").isNull() & F.col("asks").isNull()
    at = F.instr(F.col("context"), sent) - 1
    return joined.select(
        "doc_id",
        "q_id",
        F.when(failed, F.substring("context", 1, 120)).otherwise(sent).alias("answer"),
        F.when(failed, 0).otherwise(F.greatest(at, F.lit(0))).alias("char_start"),
        F.when(failed, F.least(F.lit(120), F.length("context"))).when(at >= 0, at + F.length(sent)).otherwise(F.length("context")).alias("char_end"),
        F.when(failed, 0.5).otherwise(F.round(F.coalesce("score", F.lit(0.0)), 2)).alias("confidence"),
        F.lit(True).alias("found"),
    )


def softmax_at(logits: Column, i: Column) -> Column:
    """Softmax over all of an array, at the 0-based place i."""

    def share(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
        return F.exp(F.get(logits, i).cast("double") - top) / total

    return let(F.array_max(logits).cast("double"), share)


def sliding_max(values: Column, width: int) -> Column:
    """The largest of each element and the width - 1 after it, by doubling; nulls count for nothing."""

    def widen(v: Column, reach: int) -> Column:
        step = min(reach, width - reach)
        if not step:
            return v
        return let(F.transform(v, lambda x, i: F.greatest(x, F.get(v, i + step))), lambda w: widen(w, reach + step))

    return let(values, lambda v: widen(v, 1))


def decode_spans(rows: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, q_id, i, j, best, null_score, answer, char_start, char_end, confidence, found, accepted.

    rows: doc_id, q_id, context, start_logits, end_logits, seq_ids, offsets (array of (s, e)).  The best
    pair i <= j < i + 30 from the first to the last token of the context (ties: smallest i, then j).  A
    span is rejected, for a fallback, if it scores below the null span, or its confidence, rounded to
    four digits, is below the bound.
    """
    places = F.filter(F.transform("seq_ids", lambda s, i: F.when(s == 1, i)), lambda i: i.isNotNull())

    def best(bounds: Column) -> Column:
        ends = sliding_max(F.transform("end_logits", lambda e, i: F.when(i <= bounds["high"], e)), cfg.answer_tokens)

        def best_of(ahead: Column) -> Column:
            def best_from(i: Column) -> Column:
                return F.struct((F.get("start_logits", i).cast("double") + F.get(ahead, i)).alias("score"), (-i).alias("back"), F.get(ahead, i).alias("end"), bounds["high"].alias("high"))

            return F.array_max(F.transform(F.sequence(bounds["low"], bounds["high"]), best_from))

        return F.when(bounds["low"].isNotNull(), let(ends, best_of))

    # bound once: the first and the last token of the context, then the best start
    bounds = let(places, lambda p: F.struct(F.array_min(p).alias("low"), F.array_max(p).alias("high")))
    found = rows.withColumn("b", let(bounds, best)).select("*", F.col("b.score").alias("best"), (-F.col("b.back")).alias("i"))
    ahead = F.sequence(F.col("i"), F.least(F.col("i") + cfg.answer_tokens - 1, F.col("b.high")))
    found = found.withColumn("j", F.array_min(F.filter(ahead, lambda j: F.get("end_logits", j) == F.col("b.end"))))
    null_score = F.get("start_logits", F.lit(0)).cast("double") + F.get("end_logits", F.lit(0))
    confidence = F.round(softmax_at(F.col("start_logits"), F.col("i")) * softmax_at(F.col("end_logits"), F.col("j")), 4)
    s, e = F.get("offsets", F.col("i"))["s"], F.get("offsets", F.col("j"))["e"]
    found = found.withColumns({"null_score": null_score, "confidence": confidence, "s": s, "e": e})
    raw = F.when(F.col("e") > F.col("s"), F.substring("context", F.col("s") + 1, F.col("e") - F.col("s"))).otherwise("")
    found = found.withColumn("raw", raw)
    start = F.col("s") + F.length("raw") - F.length(lstrip(F.col("raw")))
    end = F.col("e") - (F.length("raw") - F.length(rstrip(F.col("raw"))))
    accepted = F.col("best").isNotNull() & (F.col("best") >= F.col("null_score")) & (F.col("confidence") >= cfg.min_confidence)
    answer = strip(F.col("raw"))
    return found.select("doc_id", "q_id", "i", "j", "best", "null_score", answer.alias("answer"), start.alias("char_start"), end.alias("char_end"), "confidence", (answer != "").alias("found"), F.coalesce(accepted, F.lit(False)).alias("accepted"))


def read_answers(contexts: DataFrame, question_terms: DataFrame, cfg: Settings = Settings(), reader: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, q_id, answer, char_start, char_end, confidence, found of contexts(doc_id, q_id, context).

    reader: a plug-in that adds start_logits, end_logits, seq_ids and offsets to each row; a row that it
    leaves out, or gives nulls, counts as one it could not read.  A span that is rejected, and all without
    a reader, fall back to the nearest sentence.
    """
    fallback = fallback_answers(contexts, question_terms, cfg)
    if reader is None:
        return fallback
    names = ("answer", "char_start", "char_end", "confidence", "found")
    # no filter on the gates: it would be pushed below the decoding and repeat it
    spans = decode_spans(reader(contexts.select("doc_id", "q_id", "context")), cfg).select("doc_id", "q_id", F.struct("accepted", *names).alias("span"))
    joined = fallback.join(spans, ["doc_id", "q_id"], "left")
    return joined.select("doc_id", "q_id", *(F.when(F.col("span.accepted"), F.col(f"span.{c}")).otherwise(F.col(c)).alias(c) for c in names))
