"""Sources, sinks, streams, and whole runs from word boxes or an evaluation set."""

import json
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspan.config import TOO_LARGE, Settings
from quillspan.functions import text as tx
from quillspan.operators import evaluation, layout, sentences
from quillspan.plans.ask import ask, ask_boxes, evaluate, in_order_asked, smoke
from quillspan.sources import tables
from quillspan.streaming.ingest import answer_stream, sentences_of_stream


def test_files(spark, tmp_path):
    for name, content in (("a.bin", b"same"), ("b.bin", b"same"), ("c.bin", b"other"), ("d.bin", b"x" * 50), ("e.bin", b"x" * 50)):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: r for r in tables.files(spark, str(tmp_path), Settings(max_bytes=10)).collect()}
    assert sorted(got) == ["a.bin", "c.bin", "d.bin", "e.bin"] and len({r.doc_id for r in got.values()}) == 4
    assert bytes(got["a.bin"].content) == b"same" and got["a.bin"].error is None
    assert got["d.bin"].content is None and got["d.bin"].error == TOO_LARGE


def pages(content, most):
    if content == b"bad":
        raise ValueError("no such format")
    yield from content.decode().split("|")


def boxes_of(content, most):
    for nth, page in enumerate(pages(content, most)):
        for i, word in enumerate(page.split()):
            yield nth, 30.0 * i, 0.0, 30.0 * i + 25, 10.0, word


def test_parsers(spark):
    rows = spark.createDataFrame([("a", b"one two||three"), ("b", b"bad"), ("c", b""), ("d", None)], "doc_id string, content binary")
    cfg = Settings(max_pages=2)
    assert {r.doc_id: r.text for r in tables.plain_texts(rows, pages).collect()} == {"a": "one two three", "b": "", "c": ""}
    assert {r.doc_id: r.text for r in tables.plain_texts(rows, pages, cfg).collect()}["a"] == "one two"
    got = [(r.doc_id, r.page, r.seq, r.word) for r in tables.word_boxes(rows, boxes_of, cfg).orderBy("doc_id", "seq").collect()]
    assert got == [("a", 0, 0, "one"), ("a", 0, 1, "two")]


def test_evaluation_set_and_paths(spark, tmp_path):
    items = [{"paper_path": "x.pdf", "question": "Why?", "gold_answer": "So.", "gold_page": 1}, {"paper_path": "y.pdf", "question": "How?", "gold_answer": "Thus.", "gold_page": None}]
    (tmp_path / "set.json").write_text(json.dumps(items))
    read = tables.evaluation_set(spark, str(tmp_path / "set.json"))
    assert sorted((r.paper_path, r.gold_page) for r in read.collect()) == [("x.pdf", 1), ("y.pdf", None)]
    (tmp_path / "bad.json").write_text('{"paper_path": 3, ')
    with pytest.raises(Exception):
        tables.evaluation_set(spark, str(tmp_path / "bad.json")).collect()
    listing = spark.createDataFrame([("/b/x.pdf",), ("/a/x.pdf",), ("/b/z.pdf",)], "path string")
    got = {r.paper_path: r.resolved for r in tables.resolve_paths(read, listing, ["/b/", "/a"]).collect()}
    assert got == {"x.pdf": "/b/x.pdf", "y.pdf": "y.pdf"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "doc_id long, answer string, confidence double")
    assert sorted((r.doc_id, json.loads(r.response)["confidence"]) for r in tables.as_json(rows, "doc_id").collect()) == [(1, None), (2, 0.5)]
    tables.write_json(rows, str(tmp_path / "out"), "doc_id")
    assert {r.doc_id: r.answer for r in spark.read.json(str(tmp_path / "out")).collect()} == {1: "a", 2: "b"}
    runs = spark.createDataFrame([("tfidf+reranker", 5, 0.8, 0.4, 0.55), ("tfidf", 5, 1.0, 0.0, 0.25)], "label string, total_samples long, recall_at_5 double, exact_match double, f1 double")
    lines = evaluation.markdown_lines(runs, "Eval")
    assert [r.line for r in lines.orderBy("place").collect()] == [
        "# Eval  (5 samples)",
        "",
        "| Stage            | Recall@5   | Exact Match   | F1     |",
        "| ---------------- | ---------- | ------------- | ------ |",
        "| tfidf            | 1.0000     | 0.0000        | 0.2500 |",
        "| tfidf+reranker   | 0.8000     | 0.4000        | 0.5500 |",
    ]
    tables.write_lines(lines.orderBy("place").coalesce(1), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == 6
    sizes = spark.createDataFrame([("9MiB",), ("10MB",), ("none",)], "size string")
    assert evaluation.peak(sizes).first() == ("10MB", 10_000_000.0)


def test_unicode_white_space(spark):
    text = " The first sentence ends here. Another one begins after it.　 Last one of them all.\x85"
    got = [(r.sent, r.char_start) for r in sentences.split_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sent_idx").collect()]
    want = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text)]
    assert [s for s, _ in got] == want and all(text[at:].startswith(s) for s, at in got)
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    row = spark.createDataFrame([(f"{every}a{every}",)], "t string").select(tx.strip(F.col("t")).alias("s"), tx.lstrip(F.col("t")).alias("l"), tx.blank(F.lit(every)).alias("b")).first()
    assert row == ("a", "a" + every, True)


def two_column_boxes(n_pages, per_page):
    """Boxes of numbered words in two columns, with jitter and in no order; and the words as they are read."""
    rnd = random.Random(3)
    boxes, read = [], []
    for page in range(n_pages):
        for i in range(per_page):
            column, k = divmod(i, per_page // 2)
            row, col = divmod(k, 5)
            word = f"topic{page}x{i}." if k % 9 == 8 else f"{'Word' if k % 9 == 0 else 'word'}{page}x{i}"
            boxes.append((7, page, 10.0 * col * 3 + 300.0 * column, 14.0 * row, word))
            read.append((page, word))
    rnd.shuffle(boxes)
    return [(d, p, i, x, y + rnd.choice([0.0]), x + 25.0, y + 10.0, w) for i, (d, p, x, y, w) in enumerate(boxes)], read


def test_boxes_to_answers_and_pages(spark):
    rows, read = two_column_boxes(3, 240)
    boxes = spark.createDataFrame(rows, "doc_id long, page int, seq int, x0 double, y0 double, x1 double, y1 double, word string")
    ordered = sentences.word_offsets(layout.reading_order(boxes))
    text = " ".join(w for _, w in read)
    assert layout.document_texts(ordered).first().text == text
    assert all(text[r.char_start :].startswith(r.word) and (r.ord, r.page, r.word) == (r.ord, *read[r.ord]) for r in ordered.collect())
    questions = spark.createDataFrame([(p, f"what of word{p}x60 and word{p}x61?") for p in range(3)] + [(9, " ")], "q_id long, question string")
    files = spark.createDataFrame([(7, None), (8, TOO_LARGE)], "doc_id long, error string")
    got = {(r.doc_id, r.q_id): r for r in ask_boxes(boxes, questions, files=files).collect()}
    assert len(got) == 8 and all(got[7, p].page_number == p and f"word{p}x60" in got[7, p].answer for p in range(3))
    assert not got[7, 9].found and got[8, 0].error == TOO_LARGE and got[8, 9].error is None
    held = ask_boxes(boxes, questions)
    assert [r.q_id for r in in_order_asked(held, questions).collect()] == [0, 1, 2, 9]


def test_reader_and_its_gates(spark):
    docs = spark.createDataFrame([(1, "The first sentence is about apples. The second sentence is about pears and plums."), (2, "Nothing in it is to be found anywhere.")], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "what about pears?"), (2, "what about apples?"), (3, "is anything found?")], "q_id long, question string")

    def reader(rows):
        """Points at the fourth word of each context; unsure of question 2, and question 3 it leaves out."""
        at = F.instr("context", F.get(F.split("context", " "), F.lit(3))) - 1
        size = F.length(F.get(F.split("context", " "), F.lit(3)))
        high = F.when(F.col("q_id") == 2, 0.0).otherwise(9.0).cast("float")
        null = F.when(F.col("q_id") == 2, 1.0).otherwise(0.0).cast("float")
        logits = F.array(null, F.lit(0.0).cast("float"), high)
        return rows.filter("q_id < 3").select("*", logits.alias("start_logits"), logits.alias("end_logits"), F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1)).alias("seq_ids"),
                                              F.array(*(F.struct(a.alias("s"), b.alias("e")) for a, b in ((F.lit(0), F.lit(0)), (F.lit(0), F.lit(0)), (at, at + size)))).alias("offsets"))

    got = {(r.doc_id, r.q_id): r for r in ask(docs, questions, reader=reader).collect()}
    plain = {(r.doc_id, r.q_id): r for r in ask(docs, questions).collect()}
    assert got[1, 1].answer == "is" and got[1, 1].confidence > 0.9 and got[1, 1].found
    assert got[1, 2].answer == plain[1, 2].answer and got[2, 3] == plain[2, 3]


def test_evaluation_run(spark):
    docs = spark.createDataFrame([("p", "Bees make honey in the hive. Ants carry leaves to the nest."), ("q", "Rivers flow down to the sea. Lakes stay where they are."), ("p", "a copy of the same path")], "path string, text string")
    docs = docs.filter("text not like 'a copy%'")
    items = spark.createDataFrame([("p", "who make honey?", "Bees make honey in the hive."), ("q", "what flow to the sea?", "Rivers flow down to the sea."), ("p", "what flow to the sea?", "none"), ("gone", "who?", "x"), ("p", " ", "y")], "path string, question string, gold_answer string")
    got = evaluate(items, docs, {"tfidf": Settings(), "tfidf+reranker": Settings(use_reranker=True)})
    rows = {(r.path, r.question): r for r in got.filter("label = 'tfidf'").collect()}
    assert len(rows) == 5 and rows["p", "who make honey?"].exact_match and rows["q", "what flow to the sea?"].exact_match
    assert rows["p", "what flow to the sea?"].predicted_answer == "" and rows["gone", "who?"].error == "File not found" and not rows["p", " "].exact_match
    assert {r.label: (r.total_samples, r.exact_match) for r in evaluation.summary(got, "label").collect()} == {"tfidf": (5, 0.4), "tfidf+reranker": (5, 0.4)}


def test_smoke(spark):
    boxes = tables.derived_words(spark.createDataFrame([(2, "Bees make honey in the hive. Ants carry leaves to the nest.")], "doc_id long, text string"))
    got = smoke(boxes, spark.createDataFrame([(1, "who make honey?")], "q_id long, question string")).collect()
    assert len({r.label for r in got}) == 12 and all((r.n_pairs, r.n_found, r.error) == (1, 1, None) for r in got)


def test_streams(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    spark.createDataFrame([(1, "The first sentence is here. Another sentence comes after it.")], "doc_id long, text string").write.mode("overwrite").json(str(tmp_path / "docs"))
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "docs"))
    query = sentences_of_stream(stream).writeStream.format("memory").queryName("sents").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.sent for r in spark.table("sents").orderBy("sent_idx").collect()] == ["The first sentence is here.", "Another sentence comes after it."]
    asked = tmp_path / "asked"
    spark.createDataFrame([(1, "what comes after?")], "q_id long, question string").write.json(str(asked))
    questions = spark.readStream.schema("q_id long, question string").json(str(asked))
    docs = spark.read.json(str(tmp_path / "docs"))
    answer_stream(questions, docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Another sentence comes after it."]
