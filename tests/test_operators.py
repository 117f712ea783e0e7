"""Operators against small examples and plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.config import NO_TEXT, Settings
from quillspan.functions import text as tx
from quillspan.operators import answers, context, evaluation, layout, scoring, sentences, windows
from quillspan.plans.ask import Corpus, ask, question_terms, ranked
from quillspan.sources import tables


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences(spark):
    texts = ["  First sentence is here. Second one is longer!  Short. 3rd sentence begins with a digit?\nlower case does not split. Yes it does here.", "tiny", None, "", "  a short one  "]
    got = {}
    for r in sentences.split_sentences(docs_of(spark, texts)).orderBy("doc_id", "sent_idx").collect():
        got.setdefault(r.doc_id, []).append((r.sent, r.char_start))
    want = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", texts[0]) if len(s.strip()) > 15]
    assert [s for s, _ in got[0]] == want and all(texts[0][at:].startswith(s) for s, at in got[0])
    assert got[1] == [("tiny", 0)] and got[2] == got[3] == [(NO_TEXT, 0)] and got[4] == [("a short one", 2)]
    plugged = sentences.split_sentences(docs_of(spark, [texts[0]]), splitter=lambda c: F.split(c, tx.SENTENCE_END))
    assert [(r.sent, r.char_start) for r in plugged.orderBy("sent_idx").collect()] == got[0]


@pytest.mark.parametrize("n", range(1, 13))
def test_windows(spark, n):
    rows = [(0, i, f"Sent{i}.") for i in range(n)]
    got = windows.build_windows(spark.createDataFrame(rows, "doc_id long, sent_idx int, sent string")).orderBy("win_id").collect()
    starts = list(range(n)) if n < 3 else [*range(0, n - 2, 2), *([n - 3] if n % 2 == 0 else [])]
    size = 1 if n < 3 else 3
    assert [r.window for r in got] == [" ".join(f"Sent{j}." for j in range(s, s + size)) for s in starts]
    for r in got:
        assert all(r.window[o.ws : o.we] == f"Sent{o.sent_idx}." for o in r.sent_offsets)


def tfidf(question, units):
    """The plain definition: the question counts as one more text."""
    toks = [[t for t in re.findall(r"[^\W]{2,}", x.lower()) if t not in tx.STOP_WORDS] for x in [question, *units]]
    df = Counter(t for x in toks for t in set(x))
    vecs = [{t: n * (math.log((1 + len(toks)) / (1 + df[t])) + 1) for t, n in Counter(x).items()} for x in toks]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return [sum(vecs[0][t] * v.get(t, 0) for t in vecs[0]) / (norm(vecs[0]) * norm(v)) if vecs[0] and v else 0.0 for v in vecs[1:]]


def test_scores_cutoff_and_selection(spark):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(25)] + ["the", "never", "of"]
    texts = [" ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 9))).capitalize() + "." for _ in range(rnd.randint(1, 50))) for _ in range(12)]
    questions = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(4))) for i in range(5)] + [(9, "unknown terms")], "q_id long, question string")
    corpus = Corpus.of(docs_of(spark, texts))
    held = {}
    for r in corpus.windows.orderBy("doc_id", "win_id").collect():
        held.setdefault(r.doc_id, []).append(r.window)
    best = ranked(corpus, question_terms(questions)).cache()
    fast = {(r.doc_id, r.q_id): r.ids for r in scoring.select_fast(best).collect()}
    pool = {(r.doc_id, r.q_id): r.ids for r in scoring.select_pool(best).collect()}
    for d, wins in held.items():
        for q in questions.collect():
            scores = [round(s, 6) for s in tfidf(q.question, wins)]
            if max(scores) == 0:
                assert (d, q.q_id) not in fast
                continue
            order = sorted(range(len(wins)), key=lambda i: (-scores[i], i))
            place = 0.4 * (len(scores) - 1)
            low, up = sorted(scores)[int(place)], sorted(scores)[min(int(place) + 1, len(scores) - 1)]
            p40 = round(low + (up - low) * (place - int(place)), 9)
            assert fast[d, q.q_id] == sorted([i for i in order if scores[i] >= p40][:8])
            assert pool[d, q.q_id] == sorted(order[:20])


def test_rerank_prune(spark):
    rows = [(0, 0, i, s) for i, s in enumerate([3.0, 1.0, 0.9, 3.0, 2.5, 2.0])] + [(1, 0, i, s) for i, s in enumerate([-5.5, -5.6])] + [(2, 0, 0, -5.0), (2, 0, 1, -6.0)]
    got = scoring.rerank_prune(spark.createDataFrame(rows, "doc_id long, q_id long, win_id int, score double")).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.win_id) for r in got] == [(0, 0), (0, 3), (0, 4), (0, 5), (1, 0), (2, 0), (2, 1)]


def test_budget_and_context(spark):
    rows = [(0, 0, i + 1, i, " ".join(["w"] * n), [(i, 0, 1)]) for i, n in enumerate([100, 100, 60, 1])] + [(1, 0, 1, 0, " ".join(["w"] * 999), [(0, 0, 1)])]
    df = spark.createDataFrame(rows, "doc_id long, q_id long, rank int, win_id int, window string, sent_offsets array<struct<sent_idx:int,ws:int,we:int>>")
    kept = context.within_budget(df)
    assert [(r.doc_id, r.win_id) for r in kept.orderBy("doc_id", "rank").collect()] == [(0, 0), (0, 1), (1, 0)]
    made = context.assemble(kept).orderBy("doc_id").first()
    assert [made.context[o.ctx_start : o.ctx_end] for o in made.window_offsets] == [" ".join(["w"] * 100)] * 2


def test_page_of(spark):
    offsets = F.expr("array(named_struct('win_idx', 0, 'ctx_start', 0, 'ctx_end', 10), named_struct('win_idx', 1, 'ctx_start', 11, 'ctx_end', 20))")
    sents = F.expr("array(array(named_struct('sent_idx', 0, 'ws', 0, 'we', 4), named_struct('sent_idx', 1, 'ws', 5, 'we', 10)), array(named_struct('sent_idx', 2, 'ws', 0, 'we', 9)))")
    pages = F.array(F.lit(0), F.lit(3), F.lit(7))
    at = spark.createDataFrame([(c,) for c in (-1, 0, 4, 5, 10, 11, 99)], "c int")
    got = [tuple(r.p) for r in at.select(context.page_of(F.col("c"), offsets, sents, pages).alias("p")).collect()]
    assert got == [(None, None), (0, 0), (0, 0), (3, 1), (7, 2), (7, 2), (7, 2)]


def test_references(spark):
    body = "This is a body sentence of some length. " * 6
    texts = [body + "Literature Cited. Some Entry that is long enough.", body + "and REFERENCES [1] Some Entry that is long. Another Entry that is long.", body + "we made references to it. Final sentence is here.", body]
    found = sentences.mark_references(docs_of(spark, texts), sentences.split_sentences(docs_of(spark, texts)))
    got = {}
    for r in found.orderBy("doc_id", "sent_idx").collect():
        got.setdefault(r.doc_id, []).append(r.past_references)
    assert got[0] == [False] * 6 + [True] * 2 and got[1] == [False] * 6 + [True] == got[2] and not any(got[3])
    assert not any(r.past_references for r in sentences.mark_references(docs_of(spark, texts), sentences.split_sentences(docs_of(spark, texts)), layout=False).collect())
    all_past = found.filter("past_references")
    assert sentences.body(all_past).count() == all_past.count()


def test_rows_follow_the_first_word_of_each_row(spark):
    rnd = random.Random(9)
    words = [(d, 0, i, 0.0, y, 5.0, y + rnd.choice([0.0, 8.0, 10.0]), "w") for d in range(30) for i in range(40) for y in [rnd.random() * 60]]
    df = spark.createDataFrame(words, "doc_id long, page int, seq int, x0 double, y0 double, x1 double, y1 double, word string")
    got = {(r.doc_id, r.seq): r.row_id for r in layout.rows(df).collect()}
    for d in range(30):
        mine = [w for w in words if w[0] == d]
        heights = sorted(w[6] - w[4] for w in mine if w[6] > w[4])
        tol = max(heights[len(heights) // 2] * 0.5, 1.5) if heights else 3.0
        anchor, row = None, -1
        for w in sorted(mine, key=lambda w: (w[4], w[2])):
            if anchor is None or abs(w[4] - anchor) > tol:
                anchor, row = w[4], row + 1
            assert got[d, w[2]] == row


def test_two_columns_are_read_in_turn(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    words = tables.derived_words(docs, per_page=60).orderBy(F.rand(3))
    assert {r.doc_id: r.gutter is not None for r in layout.gutters(layout.rows(words)).collect()} == {1: True, 2: False}
    right = {r.doc_id: r.text.split() for r in layout.document_texts(layout.reading_order(words)).collect()}
    assert right[1][:30] != [] and {*right[1][:30]} == {f"w{i}" for i in range(30)}


def test_decode_spans(spark):
    rnd = random.Random(4)
    ctx = "The learning rate was set to 0.001 during the training of it. "
    rows = []
    for q in range(60):
        n = 40
        s, e = [rnd.randint(-16, 16) / 4 for _ in range(n)], [rnd.randint(-16, 16) / 4 for _ in range(n)]
        rows.append((0, q, ctx, s, e, [int(4 <= i < 38) for i in range(n)], [(max(0, i - 4), max(0, i - 4) + rnd.randint(1, 6)) for i in range(n)]))
    df = spark.createDataFrame(rows, "doc_id long, q_id long, context string, start_logits array<float>, end_logits array<float>, seq_ids array<int>, offsets array<struct<s:int,e:int>>")
    got = {r.q_id: r for r in answers.decode_spans(df).collect()}
    for _, q, _, s, e, _, offs in rows:
        best, where = -math.inf, None
        for i in range(4, 38):
            for j in range(i, min(i + 30, 38)):
                if s[i] + e[j] > best:
                    best, where = s[i] + e[j], (i, j)
        r = got[q]
        assert (r.i, r.j) == where and r.best == best
        raw = ctx[offs[where[0]][0] : offs[where[1]][1]]
        assert r.answer == raw.strip() and (not raw.strip() or ctx[r.char_start : r.char_end] == r.answer)


def test_token_f1(spark):
    def f1(p, g):
        import string

        a, b = p.strip().lower(), g.strip().lower()
        if a == b:
            return 1.0 if a else 0.0
        if not a or not b:
            return 0.0
        x, y = ([t for t in (w.strip(string.punctuation) for w in s.split()) if t] or s.split() for s in (a, b))
        same = sum((Counter(x) & Counter(y)).values())
        return 2 * same / len(x) * same / len(y) / (same / len(x) + same / len(y)) if same else 0.0

    cases = [("", ""), ("a", ""), (" The  cat.", "the cat"), ("?!", "..."), ("a a b", "a b b (c)"), ("x-y [z]", "x-y z\\"), ("same", "SAME ")]
    rows = spark.createDataFrame(cases, "p string, g string").select("p", "g", evaluation.token_f1(F.col("p"), F.col("g")).alias("f")).collect()
    assert all(abs(r.f - f1(r.p, r.g)) < 1e-12 for r in rows)


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(evaluation.size_bytes(F.lit("234.5MiB")).alias("x")).first().x == 234.5 * 1024**2
    assert one.select(evaluation.size_bytes(F.lit("n/a")).alias("x")).first().x == 0.0
    h = one.select(tx.highlight(F.lit("abcdef"), F.lit(1), F.lit(3)).alias("h"), tx.highlight(F.lit("ab"), F.lit(-1), F.lit(3)).alias("n")).first()
    assert tuple(h.h) == ("a", "bc", "def") and tuple(h.n) == ("ab", "", "")
    assert len(tx.STOP_WORDS) == 313


def test_ask_edges(spark):
    docs = spark.createDataFrame([(0, "The Transformer architecture was introduced in 2017 by Vaswani et al. It uses attention alone."), (1, ""), (2, "x" * 200)], "doc_id long, text string")
    questions = spark.createDataFrame([(0, "Who introduced the Transformer architecture?"), (1, "  "), (2, "What is the boiling point of nitrogen?")], "q_id long, question string")
    got = {(r.doc_id, r.q_id): r for r in ask(docs, questions, Settings(max_bytes=150)).collect()}
    r = got[0, 0]
    assert len(got) == 9 and "Vaswani" in r.answer and r.context[r.char_start : r.char_end] == r.answer and r.page_number == 0
    assert not got[0, 1].found and not got[0, 2].found and got[0, 2].page_number is None
    assert got[2, 0].error and not got[2, 1].error and not got[1, 0].found
