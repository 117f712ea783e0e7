import random

import numpy as np
import pytest

from quillspan.llm.pieces import MARK, MODEL, DoubleArray, Vocabulary, decode, encode

SCHEMA = "doc_id long, text string, ids string"
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "\n\n a \n", "x\n  y", f"a{MARK}b {MARK} {MARK}{MARK}", "é€\U0001f600\u0000\tß", "x" * 5000, "日本語" * 60, " " * 300 + "z", "l1\r\nl2"]


@pytest.fixture(scope="module")
def public():
    return Vocabulary.load(MODEL)


def small():
    rnd = random.Random(3)
    pieces = {MARK, MARK * 2, "a", "b", "é", "ab", "ba", MARK + "a", MARK + "ab", "aba", "bab", MARK + "é"}
    return Vocabulary([(i + 300, p, -rnd.random() * 6 - 1) for i, p in enumerate(sorted(pieces))], list(range(256)), [299])


def brute(voc, text):
    """Best score over the whole marked text, word borders unknown to it."""
    marked = (MARK + text.replace(MARK, "\ue123").replace(" ", MARK)) if text else ""
    pieces = {voc.shown[int(i)].decode().replace(" ", MARK): s for i, s in zip(voc.ids, voc.scores)}
    best = [0.0] + [-np.inf] * len(marked)
    for j in range(1, len(marked) + 1):
        c = marked[j - 1]
        best[j] = best[j - 1] + voc.fallback * len((MARK if c == "\ue123" else c).encode())
        for i in range(max(0, j - 16), j):
            if marked[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[marked[i:j]])
    return best[-1]


def score(voc, ids):
    of = {int(i): s for i, s in zip(voc.ids, voc.scores)}
    return sum(of.get(int(i), voc.fallback) for i in ids)


def test_trie():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    t = DoubleArray(keys)
    for k in [*keys, b"abd", b"z", b"c"]:
        state = 0
        for c in k:
            n = t.base[state] + c + 1
            state = n if t.check[n] == state else None
            if state is None:
                break
        assert (-1 if state is None else t.value[state]) == (keys.index(k) if k in keys else -1)


def test_best_score_and_round_trip(public):
    rnd = random.Random(1)
    texts = [x for x in ODD if x is not None and len(x) < 200] + ["".join(rnd.choice(f"aabbé  \n{MARK}c") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    for voc in (small(), public):
        for text, raw in zip(texts, voc.encode(texts)):
            ids = np.frombuffer(raw, dtype=np.int32).tolist()
            assert voc.decode(ids) == text
            assert abs(score(voc, ids) - brute(voc, text)) < 1e-6, repr(text)
        long = "abéba" * 40
        assert abs(score(voc, np.frombuffer(voc.encode([long])[0], dtype=np.int32)) - brute(voc, long)) < 1e-6


def test_words_beyond_what_is_kept(public, monkeypatch):
    monkeypatch.setattr("quillspan.llm.pieces.KEPT_WORDS", 0)
    voc = Vocabulary.load(MODEL)
    assert voc.encode(["some words of text"]) == public.encode(["some words of text"]) and not voc.known


def test_rows(spark, public):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], None), (None, "x", None)], SCHEMA)
    coded = encode(docs, public)
    assert coded.columns == ["doc_id", "ids"]
    back = {r.doc_id: r.text for r in decode(coded, public).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD)) and back[None] == "x"
    both = {r.doc_id: r.text for r in encode(docs, public, decoded=True).collect()}
    assert both == back
    assert encode(docs.limit(0), public).collect() == []
