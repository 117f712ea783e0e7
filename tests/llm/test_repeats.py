import hashlib
import random
import re
from collections import Counter
from pathlib import Path

from quillspan.llm.common import Scratch
from quillspan.llm.repeats import SuffixFamily, remove_repeats

SCHEMA = "doc_id long, text string, source string"


def brute(texts, match):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for s in range(len(b) - match + 1):
            seen.setdefault(b[s : s + match], []).append((d, s))
    cover = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                cover[d][s : s + match] = b"\1" * match
    out = []
    for b, c in zip(data, cover):
        marks = bytes(c)
        out.append((len(b), sum(marks), hashlib.sha256(bytes(x for x, m in zip(b, marks) if not m)).hexdigest(), len([1 for i in range(len(marks)) if marks[i] and (i == 0 or not marks[i - 1])])))
    return out


def passages(texts, n):
    """Ranges of words, flat, that strings of n words cover which start anywhere else."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        found = []
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                if found and i <= found[-1]:
                    found[-1] = i + n
                else:
                    found += [i, i + n]
        out.append(found)
    return out


def test_a_family_takes_further_batches(spark, tmp_path):
    texts, folder = fixture(), f"{tmp_path}/family"
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    first, second, third = (docs.filter(f"doc_id % 3 = {i}") for i in range(3))
    remove_repeats(first, 200, 2, 10, folder)
    remove_repeats(second, 200, 1, 10, folder, known=first)
    got = remove_repeats(third, 200, 1, 10, folder, known=first.union(second)).collect()
    assert digest(got) == sorted((i, n, r, h, s) for i, (n, r, h, s) in enumerate(brute(texts, 200)))
    assert {r.doc_id: r.passages for r in got} == dict(enumerate(passages(texts, 10)))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillspan_")]
    with Scratch(spark, "t") as scratch, SuffixFamily(scratch, (200, 10), folder) as family:
        assert [x is None for x in family.levels] == [True, True, False] and len(family.suffixes) == 3
        for how in ("full_outer", "inner"):
            plan = family.scan(family.levels[2], family.levels[2].select("*"), how)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        family.store.drop()
    assert not Path(folder).exists()


def test_one_key_holds_most_rows(spark):
    """More than a thousandth of the rows share a suffix, so hot and other keys go separate ways."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(5))
    shared = " ".join(word() for _ in range(20))
    texts = [shared + " " + " ".join(word() for _ in range(12)) + (" " + shared if i % 3 else "") for i in range(300)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    want = sorted((i, n, r, h, s) for i, (n, r, h, s) in enumerate(brute(texts, 60)))
    assert digest(remove_repeats(docs, 60, 2, 8).collect()) == want


def digest(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, sum(r.removed[1::2]) - sum(r.removed[0::2]), hashlib.sha256(r.kept).hexdigest(), len(r.removed) // 2) for r in rows)


def fixture():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(40), text(400)
    texts = [text(200), None, "", "x" * 900, "ab" * 500, long, long, long[:700] + "Q" + long[700:], shared + text(50), text(30) + shared + text(9) + shared, text(90) + long[100:520], long[101:519], text(2000)]
    texts += [long[: rnd.randint(100, len(long))] + text(20) for _ in range(12)]
    for _ in range(8):
        t = list(long)
        for _ in range(3):
            t[rnd.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts


def test_against_brute_force(spark):
    texts = fixture()
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for match, batches in ((200, 4), (97, 3), (400, 1)):
        want = sorted((i, n, r, h, s) for i, (n, r, h, s) in enumerate(brute(texts, match)))
        got = remove_repeats(docs, match, batches, passage := match // 20).collect()
        assert digest(got) == want
        assert {r.doc_id: r.passages for r in got} == dict(enumerate(passages(texts, passage)))


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(600))
    rows = [(1, long, "a"), (1, long, "a"), (None, None, None), (None, long[:500], "b"), (2, "", "k")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "key")
    got = digest(remove_repeats(docs).collect())
    want = brute([r[1] for r in rows], 400)
    assert got == sorted((r[0] if r[0] is not None else -1, n, k, h, s) for r, (n, k, h, s) in zip(rows, want))
    assert remove_repeats(docs.limit(0)).collect() == []
