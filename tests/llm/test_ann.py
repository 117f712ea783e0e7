import numpy as np

from quillspan.llm.ann import PROBES, Hashes, hadamard, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if i in queries:
            scores = [(-float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in good if j != i]
            out[i] = [(j, round(-s, 9)) for s, j in sorted((round(s, 12), j) for s, j in scores)[:k]]
    return out


def run(spark, rows, every=5, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    out = {}
    for r in nearest(df, df.filter(f"vec_id % {every} = 0"), **more).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_hadamard_is_orthogonal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    assert set(np.abs(h).ravel().round(6)) == {0.25}


def test_probes_begin_with_the_own_bucket():
    x = np.random.default_rng(2).normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = Hashes(12, 3)
    own = h.buckets(x)
    for t in range(3):
        assert all(own[i, t] in set(h.probes(x, t, 5)[i].tolist()) for i in range(20))


def test_recall_and_scores(spark):
    x = np.random.default_rng(4).normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, {i for i in range(0, 3000, 50)}, 5)
    got = run(spark, rows, 50, block=16)
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got.get(q, [])}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    true = {q: dict(brute(rows, {q}, 3000)[q]) for q in list(want)[:5]}
    assert all(abs(true[q][j] - s) < 1e-6 for q in true for j, s in got[q])


def test_ties_copies_and_odd_vectors(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, base) for i in range(30)] + [(40, [2.0, 4.0, 6.0, 8.0]), (45, [4.0, 3.0, 2.0, 1.0])]
    rows += [(50, None), (55, []), (60, [0.0] * 4), (65, [1.0, None, 1.0, 1.0]), (70, [1.0, float("nan"), 0.0, 0.0]), (75, [float("inf"), 1.0, 1.0, 1.0]), (None, base), (80, [1.0, 2.0])]
    want = brute([r for r in rows if r[0] != 80], set(range(0, 80, 5)), 5)
    assert run(spark, rows) == want
    assert run(spark, [(0, base), (5, base[::-1])]) == brute([(0, base), (5, base[::-1])], {0, 5}, 5)
    assert run(spark, [(0, None)]) == {}
    assert run(spark, [(0, base)]) == {}


def test_recall_on_many_rows_at_the_registered_setting():
    """Rows without any structure, the hardest case: what shares no bucket with a query is not found."""
    x = np.random.default_rng(6).normal(size=(50_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = x[:40]
    scores = asked @ x.T
    scores[np.arange(40), np.arange(40)] = -2
    near = np.argsort(-scores, axis=1)[:, :5]
    h = Hashes(32)
    found = np.zeros(near.shape, dtype=bool)
    codes = h.buckets(x[near.ravel()]).reshape(40, 5, -1)
    for t in range(h.tables):
        probed = h.probes(asked, t, PROBES)
        found |= (codes[:, :, t, None] == probed[:, None, :]).any(axis=2)
    assert found.mean() >= 0.95


def test_vectors_beyond_doubles_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (10, [1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.filter("vec_id % 5 = 0")).collect()
    assert sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in got) == [(0, 5, 0.8), (5, 0, 0.8)]
