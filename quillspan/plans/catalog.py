"""Named queries over the driver's tables.  ``oracle.py`` has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.functions import text as tx
from quillspan.operators import bulk, context, evaluation, layout, reading, scoring, sentences, windows
from quillspan.plans import ask, oracle
from quillspan.plans.cut import cut
from quillspan.plans.ship import ship
from quillspan.sources import tables

RERANK = Settings(use_reranker=True)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(_docs(spark, d))


def q_windows(spark: SparkSession, d: str) -> DataFrame:
    made = windows.build_windows(cut(q_sentences(spark, d)))
    return made.select("doc_id", "win_id", "window", F.size("sent_offsets").alias("n_sents"), F.get("sent_offsets", F.lit(0))["sent_idx"].alias("first_sent"), F.element_at("sent_offsets", -1)["ws"].alias("last_ws"), F.element_at("sent_offsets", -1)["we"].alias("last_we"))


def _asked(spark: SparkSession, d: str) -> bulk.Questions | None:
    """The questions as each task holds them; None if they are too many for that."""
    ship(spark)
    return bulk.Questions.of(_questions(spark, d))


def q_tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    if asked := _asked(spark, d):
        return bulk.scores(_docs(spark, d), asked)
    corpus = ask.Corpus.of(_docs(spark, d))
    return scoring.cosines(corpus.terms, corpus.counts, ask.question_terms(_questions(spark, d)), ["doc_id"], "win_id")


def _best(spark: SparkSession, d: str) -> tuple[ask.Corpus, DataFrame]:
    corpus = ask.Corpus.of(_docs(spark, d))
    return corpus, cut(ask.ranked(corpus, ask.question_terms(_questions(spark, d))))


def q_p40_cutoff(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    best = bulk.cutoffs(_docs(spark, d), asked) if asked else _best(spark, d)[1]
    return best.select("doc_id", "q_id", F.round("p40", 6).alias("p40"), "max_score", "n_scored")


def q_top8_fast(spark: SparkSession, d: str) -> DataFrame:
    if asked := _asked(spark, d):
        return bulk.fast(_docs(spark, d), asked)
    return scoring.select_fast(_best(spark, d)[1]).select("doc_id", "q_id", F.posexplode("ids").alias("nth", "win_id"))


def q_pool20(spark: SparkSession, d: str) -> DataFrame:
    if asked := _asked(spark, d):
        return bulk.pool(_docs(spark, d), asked)
    return scoring.select_pool(_best(spark, d)[1]).select("doc_id", "q_id", F.posexplode("ids").alias("nth", "win_id"))


def q_token_budget(spark: SparkSession, d: str) -> DataFrame:
    if asked := _asked(spark, d):
        return bulk.budget(_docs(spark, d), asked)
    corpus, best = _best(spark, d)
    return context.within_budget(context.chosen_windows(scoring.select_pool(best), corpus.windows)).select("doc_id", "q_id", F.col("rank"), "win_id", F.col("cum").cast("long").alias("cum"))


def _response(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "q_id", "answer", F.col("context").alias("context_md5"), "char_start", "char_end", "confidence", "found", "retrieval_confidence", "page_number", "error")


def q_ask_fast(spark: SparkSession, d: str) -> DataFrame:
    return _response(ask.ask(_docs(spark, d), _questions(spark, d), digest=True))


def q_ask_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _response(ask.ask(_docs(spark, d), _questions(spark, d), RERANK, digest=True))


def q_word_offsets(spark: SparkSession, d: str) -> DataFrame:
    return sentences.word_offsets(tables.paged_words(_docs(spark, d)))


def _paged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words = sentences.word_offsets(tables.paged_words(_docs(spark, d)).filter(F.col("page") < 25))
    return tables.joined_text(words), words


def q_sentence_page(spark: SparkSession, d: str) -> DataFrame:
    docs, words = _paged(spark, d)
    return sentences.sentence_pages(cut(sentences.split_sentences(docs)), words)


def q_page_grounding(spark: SparkSession, d: str) -> DataFrame:
    docs, words = _paged(spark, d)
    return ask.ask(docs, _questions(spark, d), words=words, digest=True).filter("found").select("doc_id", "q_id", "char_start", "char_end", "page_number")


def _with_references(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = _paged(spark, d)
    kind = F.pmod("doc_id", F.lit(4))
    tail = F.when(kind == 0, " REFERENCES [1] Smith and others wrote this. Another Entry follows it.").when(kind == 2, " End of it. Literature Cited. Some Entry that is longer.").when(kind == 3, " for this see the references to later work.").otherwise("")
    return docs.select("doc_id", F.concat("text", tail).alias("text"))


def q_references_mark(spark: SparkSession, d: str) -> DataFrame:
    docs = cut(_with_references(spark, d))
    return sentences.mark_references(docs, sentences.split_sentences(docs)).select("doc_id", "sent_idx", "past_references")


def q_body_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = cut(_with_references(spark, d))
    return sentences.body(sentences.mark_references(docs, sentences.split_sentences(docs))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_body"), F.max("sent_idx").alias("last_sent"))


def q_row_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return layout.row_tolerance(tables.derived_words(_docs(spark, d)))


def q_row_clusters(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows(tables.derived_words(_docs(spark, d))).select("doc_id", "page", "seq", "row_id")


def q_gutter_gaps(spark: SparkSession, d: str) -> DataFrame:
    return layout.gaps(layout.rows(tables.derived_words(_docs(spark, d)))).filter("gap > 0").groupBy("doc_id", "page").agg(F.count("*").alias("n_gaps"), F.max("gap").alias("widest"), layout.upper_median(F.col("gap")).alias("median_gap"))


def q_gutters(spark: SparkSession, d: str) -> DataFrame:
    return layout.gutters(layout.rows(tables.derived_words(_docs(spark, d))))


def q_column_reorder(spark: SparkSession, d: str) -> DataFrame:
    ordered = layout.reading_order(tables.derived_words(_docs(spark, d)))
    return layout.page_texts(ordered).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


def q_span_decode(spark: SparkSession, d: str) -> DataFrame:
    """Spans of whole texts, every question asked of every document."""
    ship(spark)
    return reading.of_documents(_docs(spark, d), _questions(spark, d), tables.DERIVED)


def q_ask_reader(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a reader: spans that pass the gates, else the nearest sentence."""
    return _response(ask.ask(_docs(spark, d), _questions(spark, d), reader=tables.DERIVED, digest=True))


def q_layout_answers(spark: SparkSession, d: str) -> DataFrame:
    """From word boxes of several pages to answers and their pages."""
    boxes = tables.derived_boxes(_docs(spark, d))
    return ask.ask_boxes(boxes, _questions(spark, d), brief=True).select("doc_id", "q_id", "char_start", "char_end", "page_number", "answer_md5")


def q_eval_run(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation set asked of its own documents under two settings, some of them missing, and the scores of each run."""
    sents = bulk.sentences_of(_docs(spark, d)).select("doc_id", F.explode(F.slice("sents", 1, 2)).alias("gold_answer"))
    items = sents.select(F.concat(F.lit("paper"), F.col("doc_id").cast("string")).alias("path"), F.col("gold_answer").alias("question"), "gold_answer")
    docs = _docs(spark, d).filter("doc_id % 10 <> 3").select(F.concat(F.lit("paper"), F.col("doc_id").cast("string")).alias("path"), "text")
    scored = ask.evaluate(items, docs, {"tfidf": Settings(), "tfidf+reranker": RERANK})
    return evaluation.summary(scored, "label")


def q_rerank_prune(spark: SparkSession, d: str) -> DataFrame:
    """Every window of every document, scored for every question."""
    made = cut(windows.build_windows(cut(q_sentences(spark, d))).select("doc_id", "win_id"))
    return scoring.rerank_prune(tables.derived_rerank_scores(made, _questions(spark, d)))


def q_token_f1(spark: SparkSession, d: str) -> DataFrame:
    pairs = tables.neighbours(cut(q_sentences(spark, d)))
    return evaluation.item_scores(pairs).select("doc_id", "sent_idx", "retrieval_hit", "exact_match", F.round("f1", 4).alias("f1"))


def q_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    pairs = tables.neighbours(cut(q_sentences(spark, d))).withColumn("label", F.concat(F.lit("run"), F.pmod("doc_id", F.lit(3)).cast("string")))
    return evaluation.summary(evaluation.item_scores(pairs), "label")


def q_config_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The three modes are one and the same; so a mode's rows are those of its reranker flag."""
    docs, questions = _docs(spark, d), _questions(spark, d)
    if asked := bulk.Questions.of(questions.filter("question is not null")):
        ship(spark)
        runs = bulk.sizes(docs, asked, [Settings(), RERANK])
        return evaluation.configurations(spark).join(runs, "use_reranker").select("label", "retrieval_mode", "use_reranker", "n_found", "context_chars")
    corpus, runs = ask.Corpus.of(docs), None
    for flag in (False, True):
        made = ask.contexts(corpus, questions, Settings(use_reranker=flag)).groupBy().agg(F.count(F.lit(1)).alias("n_found"), F.sum(F.length("context")).alias("context_chars")).withColumn("use_reranker", F.lit(flag))
        runs = made if runs is None else runs.union(made)
    return evaluation.configurations(spark).join(runs, "use_reranker").select("label", "retrieval_mode", "use_reranker", "n_found", "context_chars")


def q_highlight(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("n_chars").cast("int")
    rows = tables.table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.floor(first / 4)).cast("int").alias("s"), F.floor(first / 2).cast("int").alias("e"))
    return rows.select("doc_id", tx.highlight(F.col("text"), F.col("s"), F.col("e")).alias("h")).select("doc_id", F.length("h.before").alias("n_before"), "h.marked", F.length("h.after").alias("n_after"))


def q_size_guard(spark: SparkSession, d: str) -> DataFrame:
    """The guard at a bound that some texts exceed."""
    from quillspan.config import TOO_LARGE

    size = F.octet_length("text")
    return _docs(spark, d).select("doc_id", size.alias("n_bytes"), F.when(size > 4000, TOO_LARGE).alias("error"))


def q_doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.sha2(F.col("text").cast("binary"), 256).alias("doc_key"), "doc_id").groupBy("doc_key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


def q_question_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _questions(spark, d).select("q_id", F.when(F.col("q_id") % 7 == 0, " \n ").otherwise(F.col("question")).alias("question"))
    return rows.filter(~tx.blank(F.col("question"))).select("q_id", F.size(tx.tokens(F.col("question"))).alias("n_tokens"), tx.word_count_tokens(F.col("question")).alias("n_model_tokens"))


def q_size_strings(spark: SparkSession, d: str) -> DataFrame:
    units = F.element_at(F.array(*(F.lit(u) for u in ("B", "kB", "MiB", "GB", "KiB", "mb", "TB", "x"))), (F.col("doc_id") % 8 + 1).cast("int"))
    shown = F.concat((F.col("n_chars") % 1000).cast("string"), F.lit(".5"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(""), units)
    return tables.table(spark, d, "documents").select("doc_id", shown.alias("size")).select("doc_id", "size", evaluation.size_bytes(F.col("size")).alias("n_bytes"))


def q_peak_size(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.peak(q_size_strings(spark, d).withColumn("run", F.pmod("doc_id", F.lit(7))), "run")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL: dict[str, str] = oracle.SQL
