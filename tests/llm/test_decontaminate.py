import math
import random

from quillspan.llm.decontaminate import contained, decontaminate, sketches

DOCS, ITEMS = "doc_id long, text string, item long", "item_id long, text string, hash long"


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        have = shingles(t)
        for i, x in dict.fromkeys(items):
            want = shingles(x)
            if want and len(want & have) >= math.ceil(threshold * len(want) - 1e-9):
                out.append((d, i, len(want & have), len(want)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice(["", "é", "XX"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randint(6, 60))) for i in range(40)] + [(40, "one two"), (41, None), (42, " "), (43, "five words are just enough"), (1, "same id but another text here"), (None, "an item that has no id"), (43, "five words are just enough")]
    docs = [(i, text(300)) for i in range(10)]
    for n in range(60):
        words = rnd.choice(items[:40])[1].split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = word()
        docs.append((100 + n, text(rnd.randint(0, 200)) + " \n" + "\t".join(words).upper() + " " + text(rnd.randint(0, 20))))
    docs += [(500, None), (501, ""), (502, "One two"), (503, "so one two"), (504, "FIVE words are just enough " * 2000), (None, docs[20][1]), (100, docs[10][1]), (505, "x an item that has no id")]
    got = contained(spark.createDataFrame([(*d, 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()), key=str) == brute(docs, items)


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (2, "g h i j k l", 1), (None, None, 1)], DOCS)
    items = spark.createDataFrame([(7, "A b c d e", 1)], ITEMS)
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert decontaminate(docs, items.limit(0)).count() == 3
    assert contained(docs.limit(0), items).collect() == []


def test_sketches_follow_the_size_partition(spark):
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n + 4)), 1) for n in (1, 2, 3, 7, 8, 31, 32, 100)], ITEMS)
    got = {r.item_id: (len(r.shingles), r.hits, len(r.sketch)) for r in sketches(items).collect()}
    assert got == {n: (n, hits, n - math.ceil(0.8 * n - 1e-9) + hits) for n, hits in ((1, 1), (2, 1), (3, 1), (7, 1), (8, 2), (31, 2), (32, 3), (100, 3))}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr("quillspan.llm.decontaminate.BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "x a b c d e f", 1)] * 2, DOCS)
    assert contained(docs, spark.createDataFrame([(7, "A b c d e", 1)], ITEMS)).count() == 2
    test_against_brute_force(spark)
