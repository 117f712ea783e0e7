"""The pipeline on a small corpus, each stage held against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm.pii import base_spans
from quillspan.llm.pieces import Vocabulary
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import slow_components, slow_print

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bad = ["idiot", "scum", "moron"]
    items = [(i, text(20)) for i in range(5)]
    texts = [text(rnd.randint(30, 90)) for _ in range(120)]
    for i in range(0, 120, 4):
        texts[i] += " " + " ".join(rnd.choice(bad) for _ in range(4))
    texts += [texts[1], texts[1] + " x", texts[2], text(40) + " " + items[0][1].upper(), text(30) + " mail a.b@c.org or +1 (456) 555-2186 now", None, ""]
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, {i: t for i, t in enumerate(texts)}, items


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "pieces"] and corpus_pipeline.ORACLE_SQL is None


def test_run_against_plain_stages(spark, small):
    root, texts, items = small
    clean = {i: t for i, t in texts.items() if not set((t or "").split()) & {"idiot", "scum", "moron"}}
    stage = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in stage.collect()} == set(clean)
    ids = sorted(clean)
    roots = slow_components(ids, [slow_print(clean[i]) for i in ids])
    single = {i: clean[i] for i, r in zip(ids, roots) if i == r}
    hit = {d for d, *_ in brute(list(single.items()), items)}
    assert hit
    left = {i: t for i, t in single.items() if i not in hit}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(got) == set(left)
    voc = Vocabulary.load()
    for i, t in left.items():
        plain = t
        for start, end, kind in reversed(base_spans(t or "")):
            plain = plain[:start] + f"[{kind.upper()}]" + plain[end:]
        assert got[i].text == plain and got[i].n_chars == (None if t is None else len(plain))
        assert got[i].ids is None if t is None else voc.decode(list(got[i].ids)) == plain


def test_stages_take_what_they_are_given(spark, small):
    root, _, _ = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs.filter(F.lit(False)), root)
        assert out.count() == 0


def test_near_dedup_joins_links_of_simhash_and_of_shingles(spark, monkeypatch):
    """Two kinds of links lead from 9 over 5 to 2; each alone leaves two documents."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in (2, 5, 9, 11)], DOCS)
    named = lambda rows: spark.createDataFrame(rows, "doc_id long, component_id long")
    monkeypatch.setattr(corpus_pipeline.simhash, "near_duplicates", lambda d: named([(2, 2), (5, 2), (9, 9), (11, 11)]))
    monkeypatch.setattr(corpus_pipeline.near, "near_copies", lambda d: named([(2, 2), (5, 5), (9, 5), (11, 11)]))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {2, 11}


def test_near_dedup_goes_through_simhash(spark):
    """A passage told thirty times decides the fingerprint, which counts repeats; the sets of shingles differ by the rest."""
    from quillspan.llm import near, simhash

    passage = "one two three four five six seven eight nine ten eleven "
    texts = [passage * 30 + " ".join(f"own{i}x{k}" for k in range(12)) for i in range(3)] + ["something else that is long enough to have shingles"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)], DOCS)
    assert [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0, 3]
    assert {r.doc_id for r in near.keep_one(docs).collect()} == {0, 1, 2, 3}
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").orderBy("doc_id").collect()] == [0, 3]
