import random

import numpy as np
import xxhash

from quillspan.llm.common import Scratch, split_join
from quillspan.llm.components import components
from quillspan.llm.simhash import fingerprints_of, keep_one, links, masks, near_duplicates

SCHEMA = "doc_id long, text string, fp string"


def slow_print(text, size=4):
    words = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    for c in b"\t\n\v\f\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def texts():
    rnd = random.Random(3)
    words = [f"Wörd{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 120))] for _ in range(25)]
    out = [None, "", " \n\t ", "one", "ONE", "one two\x0bthree", "a b"] + [" ".join(b) for b in base]
    for _ in range(60):
        t = list(rnd.choice(base))
        t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append("  ".join(t))
    out.append(" ".join(rnd.choice(words) for _ in range(5000)))
    return out


def test_fingerprints():
    t = texts()
    assert fingerprints_of(t).tolist() == [slow_print(x) for x in t]


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    for _ in range(5000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
        assert any(not diff & m for m in masks())


def test_components_against_brute_force(spark):
    t = texts()
    ids = [i * 3 % 101 if i % 10 else None for i in range(len(t))]
    docs = spark.createDataFrame([(i, x, "y") for i, x in zip(ids, t)], SCHEMA).repartition(3)
    fps = [slow_print(x) for x in t]
    want = sorted((i if i is not None else -1, f"{f:016x}", c) for i, f, c in zip(ids, fps, slow_components(ids, fps)))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == want
    assert near_duplicates(docs.limit(0)).collect() == []
    assert {r.doc_id for r in keep_one(docs).collect()} == {c for _, _, c in want}


def test_large_buckets_are_dealt_in_blocks(spark):
    rnd = np.random.default_rng(7)
    base = int(rnd.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rnd.choice(64, 3, replace=False)) for _ in range(300)} | {int(x) for x in rnd.integers(0, 1 << 63, 200, dtype=np.uint64)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    kinds = spark.createDataFrame([(x, x) for x in signed], "fp long, node long")
    for block in (16, 100000):
        with Scratch(spark, "t") as scratch:
            edges = {(r.a, r.b) for r in links(kinds, scratch, block=block).collect()}
        assert all((a ^ b).bit_count() <= 4 if a ^ b >= 0 else ((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in edges)
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = slow_components(list(range(len(fps))), fps)
        groups = {}
        for i, x in enumerate(signed):
            groups.setdefault(find(x), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_components_of_a_star_a_path_and_a_clique(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(2000, 2060)] + [(3000 + i, 3000 + j) for i in range(30) for j in range(i)]
    with Scratch(spark, "t") as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), scratch).collect() == []
    assert got == {**{i: 0 for i in range(1500)}, **{i: 2000 for i in range(2000, 2061)}, **{i: 3000 for i in range(3000, 3030)}}


def test_split_join_is_a_join(spark):
    keys = [7] * 2000 + [8] * 900 + list(range(100, 1500)) + [None]
    rows = spark.createDataFrame(list(zip(keys, range(len(keys)))), "key long, x long")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "n").filter("key <> 105")
    want = sorted((r.key, r.x, r.n) for r in rows.join(counts, ["key"]).collect())
    assert sorted((r.key, r.x, r.n) for r in split_join(rows, counts, ["key"], len(keys)).collect()) == want
