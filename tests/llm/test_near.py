import random

import numpy as np

import corpus_pipeline
from quillspan.llm.near import forest, keep_one, links, near_copies, node_of, shingle_set

SCHEMA = "doc_id long, text string, lang string"


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def slow_roots(sets, similar=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similar:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def texts():
    rnd = random.Random(8)
    words = [f"Wörd{i}" for i in range(3000)]
    out = [None, "", " \n\t ", "one", "ONE", "one two\x0bthree", "a b"]
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 400))]
        out.append(" ".join(base))
        for _ in range(4):
            t = list(base)
            for _ in range(rnd.randint(0, len(t) // 25)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append("  ".join(t))
    return out


def test_components_against_brute_force(spark):
    t = texts()
    ids = [i * 3 % 307 if i % 10 else None for i in range(len(t))]
    docs = spark.createDataFrame([(i, x, "y") for i, x in zip(ids, t)], SCHEMA).repartition(3)
    roots = slow_roots([shingle_set(x) for x in t])
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in near_copies(docs).collect())
    assert got == sorted((-1 if i is None else i, -1 if least[r] is None else least[r]) for i, r in zip(ids, roots))
    assert {r.doc_id for r in keep_one(docs).collect()} == set(least.values())
    assert near_copies(docs.limit(0)).collect() == []


def test_stage_drops_what_lies_beyond_four_bits_and_keeps_what_is_less_similar(spark):
    rnd = random.Random(2)
    rows, want = [], set()
    for i in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        near, far = list(base), list(base)
        for k in (20, 60, 100, 140):
            near[k] = "other"
        for k in range(10, 190, 18):
            far[k] = "other"
        rows += [(3 * i + n, " ".join(x), "en") for n, x in enumerate((base, near, far))]
        assert jaccard(shingle_set(rows[-3][1]), shingle_set(rows[-2][1])) >= 0.8 > max(jaccard(shingle_set(rows[-1][1]), shingle_set(r[1])) for r in rows[-3:-1])
        want |= {3 * i, 3 * i + 2}
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == want


def test_large_bands_are_dealt_in_blocks(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, 52, replace=False), rnd.integers(0, 1 << 64, 2, dtype=np.uint64)])) for _ in range(150)]
    nodes = np.array([node_of(s) for s in sets], dtype=np.uint64).view(np.int64).tolist()
    want = slow_roots(sets)
    rows = spark.createDataFrame([(1, n, len(nodes)) for n in nodes], "key long, node long, n long")
    held = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(nodes, sets)], "node long, shingles binary")
    at = {n: i for i, n in enumerate(nodes)}
    for block in (16, 100000):
        root = list(range(len(sets)))
        for r in links(rows, held, block=block).collect():
            assert jaccard(sets[at[r.a]], sets[at[r.b]]) >= 0.8
            a, b = root[at[r.a]], root[at[r.b]]
            root = [min(a, b) if x in (a, b) else x for x in root]
        assert root == want and 1 < len(set(want)) < len(sets)
    assert len(forest(sets, 0.8)) == len(sets) - len(set(want))
