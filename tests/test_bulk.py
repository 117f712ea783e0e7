"""Questions asked of whole documents: no shuffle of pairs, and the rows of the joins."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.operators import bulk, context, scoring
from quillspan.plans import ask, catalog


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(11)
    words = ["Alpha", "beta", "gamma", "delta", "eps_ilon", "ß2", "the", "of", "x", "42", "Ünïcode"]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) + rnd.choice([".", "!", ".  Tail of it", ""])
    texts = [rnd.choice([" ", "\n", "  "]).join(sentence() for _ in range(n)) for n in [0, 1, 2, 3, 4, 5, 8, 13, 60, 300]]
    texts += [None, "", " \n ", "the of the of the of the of.", "Go. No. It. We. Alpha. Be. Me. To a. b. c. d.", "Alpha beta gamma delta. " * 40, "alpha. beta gamma delta eps. Alpha beta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = ["alpha beta?", "gamma gamma delta 42", "the of", "", "zzz unknown", "ünïcode ß2 ALPHA", None, "eps_ilon tail"]
    return docs, spark.createDataFrame(list(enumerate(asked)), "q_id long, question string")


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def by_joins(docs, questions):
    """What the joins make: scores, cutoffs, fast, pool, budget."""
    corpus = ask.Corpus.of(docs)
    terms = ask.question_terms(questions)
    best = ask.ranked(corpus, terms).cache()
    listed = lambda df: df.select("doc_id", "q_id", F.posexplode("ids"))
    return {
        "scores": scoring.cosines(corpus.terms, corpus.counts, terms, ["doc_id"], "win_id"),
        "cutoffs": best.select("doc_id", "q_id", "p40", "max_score", "n_scored"),
        "fast": listed(scoring.select_fast(best)),
        "pool": listed(scoring.select_pool(best)),
        "budget": context.within_budget(context.chosen_windows(scoring.select_pool(best), corpus.windows)).select("doc_id", "q_id", "rank", "win_id", "cum"),
    }


@pytest.mark.parametrize("block, cells, terms", [(256, 1 << 21, 1 << 20), (3, 40, 50)])
def test_rows_of_the_joins(odd, monkeypatch, block, cells, terms):
    monkeypatch.setattr(bulk.Questions.blocks, "__defaults__", (block,))
    for name, value in (("BLOCK", block), ("CELLS", cells), ("TERMS", terms)):
        monkeypatch.setattr(bulk, name, value)
    docs, questions = odd
    asked = bulk.Questions.of(questions)
    for name, df in by_joins(docs, questions).items():
        want = rows(df)
        assert want and rows(getattr(bulk, name)(docs, asked)) == want, name


@pytest.mark.parametrize("name", ["p40_cutoff", "pool20", "tfidf_scores", "top8_fast", "token_budget"])
def test_no_row_is_shuffled(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Scan ExistingRDD" not in plan


def test_too_many_terms_take_the_joins(spark, sf_dir, odd, monkeypatch):
    docs, questions = odd
    assert bulk.Questions.of(questions, most=3) is None
    want = rows(catalog.q_top8_fast(spark, sf_dir))
    monkeypatch.setattr(bulk.Questions.of, "__defaults__", (3,))
    assert rows(catalog.q_top8_fast(spark, sf_dir)) == want


def both(monkeypatch, make):
    """Rows by the joins and by the batches."""
    with monkeypatch.context() as m:
        m.setattr(bulk, "able", lambda *a: False)
        joined = make().collect()
    key = lambda r: (str(r["doc_id"]), r["q_id"])
    return sorted(joined, key=key), sorted(make().collect(), key=key)


@pytest.mark.parametrize("cfg", [Settings(), Settings(use_reranker=True), Settings(max_bytes=200)])
@pytest.mark.parametrize("terms", [1 << 20, 60])
def test_answers_of_the_joins(odd, monkeypatch, cfg, terms):
    monkeypatch.setattr(bulk, "TERMS", terms)
    docs, questions = odd
    joined, made = both(monkeypatch, lambda: ask.ask(docs, questions, cfg))
    assert made == joined and len(made) == docs.count() * 8 and {r["found"] for r in made} == {True, False}


def test_digest_and_ids_that_are_strings(odd, monkeypatch):
    docs, questions = odd
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    joined, made = both(monkeypatch, lambda: ask.ask(named, questions, digest=True))
    assert made == joined and {len(r["context"]) for r in made} == {32}


def test_pages_and_references_of_the_joins(spark, odd, monkeypatch):
    docs, questions = odd
    from quillspan.operators import sentences
    from quillspan.sources import tables

    words = sentences.word_offsets(tables.paged_words(docs, per_page=7))
    text = tables.joined_text(words).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" References. Some Alpha entry in it."))).otherwise(F.col("text")))
    joined, made = both(monkeypatch, lambda: ask.ask(text, questions, words=words))
    assert made == joined and len({r["page_number"] for r in made}) > 3


@pytest.mark.parametrize("name", ["ask_fast", "ask_rerank"])
def test_no_response_is_shuffled(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_sizes_are_sums_of_contexts(odd):
    docs, questions = odd
    asked = bulk.Questions.of(questions.filter("question is not null"))
    runs = [Settings(), Settings(use_reranker=True)]
    got = {r["use_reranker"]: (r["n_found"], r["context_chars"]) for r in bulk.sizes(docs, asked, runs).collect()}
    corpus = ask.Corpus.of(docs)
    for cfg in runs:
        want = ask.contexts(corpus, questions.filter("question is not null"), cfg).agg(F.count(F.lit(1)), F.sum(F.length("context"))).first()
        assert got[cfg.use_reranker] == tuple(want)


def test_boxes_are_answered_in_batches(spark, odd):
    from quillspan.sources import tables

    docs, questions = odd
    made = ask.ask_boxes(tables.derived_words(docs.filter("doc_id in (3, 4)")), questions, digest=True)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert {len(r["context"]) for r in made.collect()} == {32}


@pytest.mark.parametrize("cfg", [Settings(), Settings(use_reranker=True, min_confidence=0.4)])
@pytest.mark.parametrize("terms", [1 << 20, 60])
def test_spans_of_a_reader_as_by_the_joins(odd, monkeypatch, cfg, terms):
    from quillspan.sources import tables

    monkeypatch.setattr(bulk, "TERMS", terms)
    docs, questions = odd
    joined, made = both(monkeypatch, lambda: ask.ask(docs, questions, cfg, reader=tables.DERIVED))
    plain = {(r["doc_id"], r["q_id"]): r for r in ask.ask(docs, questions, cfg).collect()}
    kept = sum(r == plain[r["doc_id"], r["q_id"]] for r in made if r["found"])
    assert made == joined and 0 < kept < sum(r["found"] for r in made)


def test_pages_of_spans(odd, monkeypatch):
    from quillspan.operators import sentences
    from quillspan.sources import tables

    docs, questions = odd
    words = sentences.word_offsets(tables.paged_words(docs, per_page=7))
    joined, made = both(monkeypatch, lambda: ask.ask(tables.joined_text(words), questions, words=words, reader=tables.DERIVED))
    assert made == joined and len({r["page_number"] for r in made}) > 3


def test_no_response_of_a_reader_is_shuffled(spark, sf_dir):
    plan = catalog.QUERIES["ask_reader"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_items_are_answered_as_by_the_joins(spark, odd):
    from quillspan.sources import tables

    docs, questions = odd
    path = F.concat(F.lit("p"), "doc_id")
    items = docs.crossJoin(questions).select(path.alias("path"), "question", F.substring("text", 3, 9).alias("gold_answer"), "q_id").drop("q_id")
    items = items.union(items.limit(3)).union(spark.sql("SELECT 'gone', 'alpha', 'beta' UNION ALL SELECT NULL, 'alpha', NULL"))
    texts = docs.filter("doc_id <> 5").select(path.alias("path"), "text")
    runs = {"a": Settings(), "b": Settings(use_reranker=True), "c": Settings(window=2, stride=1, min_sentence=5)}
    made = ask.evaluate(items, texts, runs)
    # a plug-in of rows takes the joins; this one reads nothing
    joined = ask.evaluate(items, texts, runs, reader=lambda rows: tables.derived_logits(rows).filter("false"))
    key = lambda r: tuple(str(v) for v in r)
    columns = sorted(joined.columns)
    got, want = (sorted(df.select(columns).collect(), key=key) for df in (made, joined))
    assert sorted(made.columns) == columns and got == want and len(got) == 3 * (17 * 8 + 5)


def test_texts_of_items_meet_once(spark, sf_dir):
    plan = catalog.QUERIES["eval_run"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Scan ExistingRDD" not in plan and "Window" not in plan
