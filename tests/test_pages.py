"""Word boxes read where a document lies: the rows of the joins, and nothing of a box or a pair shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.config import Settings
from quillspan.operators import bulk, layout, pages, sentences
from quillspan.plans import ask, catalog
from quillspan.sources import tables


@pytest.fixture(scope="module")
def boxes(spark):
    """Pages of one and two columns with ragged rows, ties, missing coordinates and words, and references sections."""
    rnd = random.Random(5)
    vocabulary = ["Alpha", "beta.", "gamma", "Delta", "ß2", "of", "x.", "Ünïcode!", "42", "with  space", ""]
    made = []
    for doc in range(30):
        for page in rnd.sample(range(30), rnd.randint(0, 4)):
            two, tilt = rnd.random() < 0.6, rnd.choice([0.0, 0.4, 1.6])
            for row in range(rnd.randint(1, 14)):
                x = rnd.choice([0.0, 3.0])
                for k in range(rnd.randint(1, 8)):
                    x += rnd.choice([0.0, 0.5, 1.0]) + (rnd.choice([40.0, 60.0]) if two and k == 4 else 0.0)
                    y = row * rnd.choice([6.0, 10.0]) + rnd.random() * tilt
                    made.append((doc, page, len(made), x, y, x + 20.0, y + rnd.choice([0.0, 8.0, 9.0, -1.0]), rnd.choice(vocabulary)))
                    x += 20.0
            if rnd.random() < 0.4:
                made += [(doc, page, len(made) + i, 900.0 * i, 400.0, 900.0 * i + 8.0, 409.0, w) for i, w in enumerate(["it.", "References", "[1]", "Some", "Entry", "in", "Alpha."])]
    for k in range(0, len(made), 211):
        made[k] = (*made[k][:3], *(None if rnd.random() < 0.4 else v for v in made[k][3:]))
    rnd.shuffle(made)
    return spark.createDataFrame(made, "doc_id long, page int, seq int, x0 double, y0 double, x1 double, y1 double, word string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(["alpha beta?", "gamma delta 42", "", None, "ünïcode ß2"])), "q_id long, question string")


@pytest.mark.parametrize("most, cfg", [(1 << 17, Settings()), (50, Settings(use_layout=False)), (50, Settings(max_bytes=400, max_pages=9))])
def test_sentences_and_pages_of_the_joins(boxes, monkeypatch, most, cfg):
    monkeypatch.setattr(pages, "BOXES", most)
    ordered = sentences.word_offsets(layout.reading_order(boxes, cfg.max_pages))
    docs = layout.document_texts(ordered).withColumn("error", F.when(F.octet_length("text") > cfg.max_bytes, "large"))
    want = {r.doc_id: r for r in ask._sentences(docs, cfg, ordered).collect()}
    got = {r.doc_id: r for r in pages.sentences_of(pages.gathered(boxes, cfg.max_pages), cfg).collect()}
    assert set(got) == set(want) and len(got) > 10
    for k, r in want.items():
        assert (got[k].error is None) == (r.error is None) and (r.error is not None or (got[k].sents, got[k].page) == (r.sents, r.page)), k
    assert cfg.use_layout is False or len({p for r in got.values() for p in r.page}) > 5


@pytest.mark.parametrize("files", [False, True])
def test_answers_of_the_joins(spark, boxes, questions, monkeypatch, files):
    named = spark.createDataFrame([(k, "broken" if k == 3 else None) for k in (1, 2, 3, 4, 77)], "doc_id long, error string") if files else None
    make = lambda: sorted(ask.ask_boxes(boxes, questions, files=named).collect(), key=lambda r: (r.doc_id, r.q_id))
    made = make()
    monkeypatch.setattr(bulk, "able", lambda *a: False)
    assert made == make() and {r.found for r in made} == {True, False} and len({r.page_number for r in made}) > 3


def test_brief_responses_are_those_found(boxes, questions):
    from hashlib import md5

    few = boxes.filter("doc_id < 8")
    for reader in (None, tables.DERIVED):
        full = ask.ask_boxes(few, questions, reader=reader).filter("found").collect()
        brief = ask.ask_boxes(few, questions, reader=reader, brief=True).collect()
        want = sorted((r.doc_id, r.q_id, md5(r.answer.encode()).hexdigest(), r.char_start, r.char_end, r.page_number) for r in full)
        assert want and sorted(map(tuple, brief)) == want


def test_derived_boxes_in_both_forms(spark):
    text = " ".join(f"w{i}" + ("." if i % 9 == 0 else "") for i in range(700))
    docs = spark.createDataFrame([(k, text if k % 3 else t) for k, t in enumerate(["a b", text[:900], "", None, "   ", "é Two. Three"] * 2, -3)], "doc_id long, text string")
    held = tables.derived_boxes(docs)
    got, want = (pages.sentences_of(b).orderBy("doc_id").collect() for b in (held, pages.gathered(held.rows(held.docs))))
    assert got == want and 0 < len(got) < 12


def test_neither_boxes_nor_pairs_are_shuffled(spark, sf_dir):
    plan = catalog.QUERIES["layout_answers"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(w in plan for w in ("Exchange", "Join", "Window", "Scan ExistingRDD"))


def test_boxes_that_come_as_rows_are_shuffled_once(boxes, questions):
    plan = ask.ask_boxes(boxes, questions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
