"""Questions asked of documents: retrieval, context, answer and page, for all pairs at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.config import NO_TEXT, TOO_LARGE, Settings
from quillspan.functions.text import blank, tokens
from quillspan.operators import answers, bulk, context, evaluation, layout, pages, reading, scoring, sentences, windows
from quillspan.plans.cut import cut
from quillspan.plans.ship import ship


def question_terms(questions: DataFrame) -> DataFrame:
    return cut(scoring.term_counts(questions, ["q_id"], "question"))


@dataclass
class Corpus:
    """Sentences with pages, windows and their terms, made once for any number of questions."""

    sentences: DataFrame
    windows: DataFrame
    terms: DataFrame
    counts: DataFrame

    @staticmethod
    def of(docs: DataFrame, cfg: Settings = Settings(), words: DataFrame | None = None) -> Corpus:
        """docs(doc_id, text); words(doc_id, page, char_start, ...) give pages and make the references section count."""
        found = sentences.split_sentences(docs, cfg)
        layout = words is not None and cfg.use_layout
        paged = sentences.sentence_pages(found, words) if layout else found.withColumn("page", F.lit(0))
        held = cut(sentences.mark_references(docs, paged, layout))
        made = cut(windows.build_windows(sentences.body(held), cfg))
        terms = cut(scoring.term_counts(made, ["doc_id", "win_id"], "window"))
        return Corpus(held, made, terms, made.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n")))


def ranked(corpus: Corpus, terms: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return scoring.ranked(scoring.cosines(corpus.terms, corpus.counts, terms, ["doc_id"], "win_id"), corpus.counts, cfg)


def contexts(corpus: Corpus, questions: DataFrame, cfg: Settings = Settings(), scorer=None, terms: DataFrame | None = None, own: bool = False) -> DataFrame:
    """doc_id, q_id, context, window_offsets, window_sent_offsets, retrieval_confidence of pairs with a context.

    scorer: a plug-in that adds a column score to rows (doc_id, q_id, win_id, window, ...).  Without one
    a reranker keeps its pool as it is.  The pairs without any term on either side get the first window.
    terms: of the questions, if known.  own: each question belongs to the document of its own id only.
    """
    terms = question_terms(questions) if terms is None else terms
    best = cut(ranked(corpus, terms, cfg))
    rows = context.chosen_windows(scoring.select_pool(best, cfg) if cfg.use_reranker else scoring.select_fast(best, cfg), corpus.windows)
    if cfg.use_reranker and scorer is not None:
        kept = scoring.rerank_prune(scorer(rows), cfg).select("doc_id", "q_id", "win_id", "rank")
        rows = rows.drop("rank").join(kept, ["doc_id", "q_id", "win_id"])
    if cfg.use_reranker:
        rows = context.within_budget(rows, cfg)
    found = context.assemble(rows).withColumn("retrieval_confidence", F.lit(1.0))
    wordless = corpus.counts.select("doc_id").join(corpus.terms.select("doc_id").distinct(), "doc_id", "left_anti")
    empty = questions.filter(F.size(tokens(F.col("question"))) == 0).select("q_id")
    apart = wordless.crossJoin(empty) if not own else wordless.join(empty, wordless["doc_id"] == empty["q_id"])
    first = apart.withColumn("ids", F.array(F.lit(0)))
    return found.unionByName(context.assemble(context.chosen_windows(first, corpus.windows)).withColumn("retrieval_confidence", F.lit(0.0)))


def _sentences(docs: DataFrame, cfg: Settings, words: DataFrame | None) -> DataFrame:
    """doc_id, error, sents, page: the sentences before the references and their pages, one row a document."""
    read = docs.filter("error is null")
    if words is None or not cfg.use_layout:
        made = bulk.sentences_of(docs.select("doc_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error"), cfg, "error")
        return made.withColumn("page", F.transform("sents", lambda s: F.lit(0)))
    body = sentences.body(sentences.mark_references(read, sentences.sentence_pages(sentences.split_sentences(read, cfg), words)))
    held = body.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sent", "page"))).alias("s"))
    rows = docs.select("doc_id", "error").join(held, "doc_id", "left")
    return rows.select("doc_id", "error", F.transform("s", lambda s: s["sent"]).alias("sents"), F.transform("s", lambda s: s["page"]).alias("page"))


def _batched(docs: DataFrame, questions: DataFrame, scorer, reader) -> tuple[bulk.Questions, np.ndarray] | None:
    """The questions as each task holds them, and the blank ones, where pairs can be answered where their document lies."""
    if scorer is not None or not (reader is None or isinstance(reader, reading.Reader)) or not bulk.able(docs, questions):
        return None
    if not (held := bulk.Questions.of(questions.filter(~blank(F.col("question"))))):
        return None
    ship(docs.sparkSession)
    return held, questions.filter(blank(F.col("question"))).select("q_id").toArrow()["q_id"].to_numpy()


def ask(docs: DataFrame, questions: DataFrame, cfg: Settings = Settings(), words: DataFrame | None = None, scorer=None, reader=None, digest: bool = False, brief: bool = False) -> DataFrame:
    """A response for each document and question: answer, context, places, confidences, page and error.

    docs(doc_id, text[, error]), questions(q_id, question).  Blank questions, empty and too large documents
    and those with an error are answered without being read.  reader: a model as in ``answers.read_answers``;
    without one the answer is the nearest sentence of the context.  digest: the MD5 of contexts in their place.
    brief: only the responses that are found, in the columns of ``bulk.SPOT``.
    Without plug-ins, or with a reader that takes batches (``reading.Reader``), pairs are answered where their document
    lies (``bulk``), unless the questions are too many.
    """
    large = F.octet_length(F.coalesce("text", F.lit(""))) > cfg.max_bytes
    error = F.coalesce(F.col("error") if "error" in docs.columns else F.lit(None).cast("string"), F.when(large, TOO_LARGE))
    sized = docs.select("doc_id", "text", error.alias("error"))
    asked = questions.filter(~blank(F.col("question")))
    if held := _batched(docs, questions, scorer, reader):
        return bulk.answers(_sentences(sized, cfg, words), *held, cfg, digest, reader, brief)
    corpus = Corpus.of(sized.filter("error is null").select("doc_id", "text"), cfg, words)
    terms = question_terms(asked)
    found = cut(contexts(corpus, asked, cfg, scorer, terms))
    answered = answers.read_answers(found, terms, cfg, reader)
    by_sent = corpus.sentences.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "page"))), lambda s: s["page"]).alias("pages"))
    full = found.join(answered, ["doc_id", "q_id"]).join(by_sent, "doc_id")
    full = full.withColumn("page_number", context.page_of(F.col("char_start"), F.col("window_offsets"), F.col("window_sent_offsets"), F.col("pages"))["page_number"])
    every = sized.select("doc_id", "error").crossJoin(questions.select("q_id", blank(F.col("question")).alias("void")))
    out = every.join(full, ["doc_id", "q_id"], "left")
    if brief:
        return out.filter("found").select("doc_id", "q_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "char_start", "char_end", "page_number")
    return out.select(
        "doc_id", "q_id",
        F.coalesce("answer", F.lit("")).alias("answer"), (F.md5(F.coalesce("context", F.lit("")).cast("binary")) if digest else F.coalesce("context", F.lit(""))).alias("context"),
        F.coalesce("char_start", F.lit(-1)).alias("char_start"), F.coalesce("char_end", F.lit(-1)).alias("char_end"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("retrieval_confidence", F.lit(0.0)).alias("retrieval_confidence"), "page_number",
        F.when(~F.col("void"), F.col("error")).alias("error"),
    )


def ask_boxes(boxes: DataFrame | pages.Boxes, questions: DataFrame, cfg: Settings = Settings(), scorer=None, reader=None, files: DataFrame | None = None, digest: bool = False, brief: bool = False) -> DataFrame:
    """Responses from word boxes(doc_id, page, seq, x0, y0, x1, y1, word): reading order, text, answers and their pages.

    files(doc_id, error), if given, adds documents that have no words or were not read: their text is empty
    and their error is told.  Without plug-ins of rows a document's boxes are put in order and read where they lie (``pages``).
    """
    held = boxes if isinstance(boxes, pages.Boxes) else pages.gathered(boxes, cfg.max_pages)
    if asked := _batched(held.docs, questions, scorer, reader):
        sents = pages.sentences_of(held, cfg)
        if files is not None:
            sents = _of_files(files, sents)
        return bulk.answers(sents, *asked, cfg, digest, reader, brief)
    ordered = sentences.word_offsets(cut(layout.reading_order(held.rows(held.docs), cfg.max_pages)))
    docs = layout.document_texts(ordered)
    if files is not None:
        docs = files.select("doc_id", "error").join(docs, "doc_id", "left")
    return ask(docs, questions, cfg, ordered, scorer, reader, digest, brief)


def _of_files(files: DataFrame, sents: DataFrame) -> DataFrame:
    """doc_id, error, sents, page of files(doc_id, error): their error comes first, and no words are an empty text."""
    made = files.select("doc_id", "error").join(sents.withColumnRenamed("error", "own"), "doc_id", "left")
    none = F.col("sents").isNull()
    return made.select(
        "doc_id", F.coalesce("error", "own").alias("error"),
        F.when(none, F.array(F.lit(NO_TEXT))).otherwise(F.col("sents")).alias("sents"), F.when(none, F.array(F.lit(0))).otherwise(F.col("page")).alias("page"),
    )


def evaluate(items: DataFrame, docs: DataFrame, configurations: dict[str, Settings], scorer=None, reader=None) -> DataFrame:
    """Scores of each item under each configuration: label, the item's columns, the response's, retrieval_hit, exact_match, f1.

    items(path, question, gold_answer); docs(path, text).  Each question is asked of its own document only.
    An item whose document is missing has an error, no answer, and counts.  Without plug-ins, or with a reader that
    takes batches, an item is answered in a row with its text, under all configurations at once.
    """
    if scorer is None and (reader is None or isinstance(reader, reading.Reader)):
        ship(items.sparkSession)
        rows = items.withColumn("q_id", F.xxhash64("path", "question"))
        texts = docs.select("path", "text").dropDuplicates(["path"])
        asked = rows.select("path", "q_id", "question", F.struct(*rows.columns).alias("item")).join(texts, "path", "left").withColumn("error", F.when(F.col("text").isNull(), "File not found"))
        made = bulk.own_answers(asked, configurations, reader)
        told = F.when(F.col("char_start") >= 0, F.col("confidence"))
        return evaluation.item_scores(made.select("item.*", "error", F.col("answer").alias("predicted_answer"), "context", told.alias("confidence"), "page_number", "label"))
    held = cut(items.withColumn("q_id", F.xxhash64("path", "question")))
    missing = F.when(F.col("text").isNull(), "File not found")
    pairs = held.select("path", "question", "q_id").distinct().join(docs.select("path", "text").dropDuplicates(["path"]), "path", "left").withColumn("missing", missing)
    # a document for each pair, so that each document meets its own question alone
    scored = None
    asked = cut(pairs.select(F.col("q_id").alias("doc_id"), "q_id", "question", "text", "missing"))
    for label, cfg in configurations.items():
        got = ask_own(asked.filter("missing is null"), cfg, scorer, reader).select("q_id", F.col("answer").alias("predicted_answer"), "context", "confidence", "page_number")
        rows = held.join(asked.select("q_id", F.col("missing").alias("error")), "q_id").join(got, "q_id", "left").withColumn("label", F.lit(label))
        made = evaluation.item_scores(rows.fillna("", ["predicted_answer", "context"]))
        scored = made if scored is None else scored.unionByName(made)
    return scored


def ask_own(pairs: DataFrame, cfg: Settings = Settings(), scorer=None, reader=None) -> DataFrame:
    """Responses of pairs(doc_id, q_id, question, text) with doc_id = q_id: each text is asked its own question only."""
    corpus = Corpus.of(pairs.select("doc_id", "text"), cfg)
    terms = question_terms(pairs.filter(~blank(F.col("question"))))
    # a question's terms stay with its own document: the term carries the pair's id
    own = lambda df, key: df.withColumn("tok", F.concat_ws(" ", F.col(key).cast("string"), "tok"))
    mine = Corpus(corpus.sentences, corpus.windows, cut(own(corpus.terms, "doc_id")), corpus.counts)
    found = cut(contexts(mine, pairs.select("q_id", "question"), cfg, scorer, cut(own(terms, "q_id")), own=True).filter("doc_id = q_id"))
    answered = answers.read_answers(found, terms, cfg, reader)
    by_sent = corpus.sentences.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "page"))), lambda s: s["page"]).alias("pages"))
    full = found.join(answered, ["doc_id", "q_id"]).join(by_sent, "doc_id")
    return full.withColumn("page_number", context.page_of(F.col("char_start"), F.col("window_offsets"), F.col("window_sent_offsets"), F.col("pages"))["page_number"])


def in_order_asked(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses sorted by document and then as the questions are numbered, whatever order they were answered in; repeated questions answer as often."""
    return questions.select("q_id").join(responses, "q_id").orderBy("doc_id", "q_id")


def smoke(boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """label, layout, retrieval_mode, use_reranker, n_pairs, n_found of all twelve settings; one that fails says why in error and has no counts.

    The three modes are one and the same, so each run stands for three.
    """
    spark, rows = boxes.sparkSession, []
    for layout_flag in (True, False):
        for reranker in (False, True):
            try:
                found = ask_boxes(boxes, questions, Settings(use_layout=layout_flag, use_reranker=reranker))
                counts = (*found.agg(F.count(F.lit(1)), F.count_if("found")).first(), None)
            except Exception as problem:  # a smoke test tells what failed and goes on
                counts = (None, None, f"{type(problem).__name__}: {problem}")
            rows += [(f"layout={layout_flag} mode={mode} rerank={reranker}", layout_flag, mode, reranker, *counts) for mode in ("tfidf", "dense", "hybrid")]
    return spark.createDataFrame(rows, "label string, layout boolean, retrieval_mode string, use_reranker boolean, n_pairs long, n_found long, error string")
