import numpy as np
import pytest

from quarrylight.llm import cover_tree
from quarrylight.llm.cover_tree import Best, CoverTree, dual_search, top_k


def slow(rows, queries, k):
    fine = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in fine)
    fine = [(i, np.r_[v, np.zeros(width - len(v))]) for i, v in fine]
    out = []
    for q in queries:
        qv = min((tuple(v) for i, v in fine if i == q), default=None)
        if qv is not None:
            found = sorted((-int(np.dot(qv, v)), i) for i, v in fine if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [3, 2000])
def test_against_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 16)) * 3
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(clusters)] + rng.normal(size=16) * 0.2)]) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(200)]  # copies: ties go to the smaller id
    rows += [(5000, None), (5001, [1.0, None] + [0.0] * 14), (5002, [float("nan")] + [0.0] * 15), (5003, [float("inf")] * 16), (None, [1.0] * 16), (5004, []), (5005, [9.0, 9.0]), (50, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(6)
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == slow(rows, sorted({i for i, _ in rows if i is not None and i % 50 == 0}), 5)


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema)
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_query_chunks_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(cover_tree, "QUERIES", 4)
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == slow(rows, range(0, 700, 50), 5)


def test_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0]), (4, [2.0**50, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r["rank"], r.score) for r in top_k(df, df.where("vec_id = 0")).collect()}
    assert got[1][1] == 2**62 and got[2][1] == -(2**62) and got[3] == (3, 256 * 256) and [got[k][0] for k in (1, 4, 3, 2)] == [1, 2, 3, 4]


def test_pairs_are_pruned():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32)) * 100
    data = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(8000, 32)))
    queries = data[::50]
    best = Best(np.arange(0, 8000, 50), 5)
    looked = dual_search(CoverTree(queries), CoverTree(data), np.arange(8000), best)
    assert looked < 0.5 * len(queries) * len(data)
    scores = queries @ data.T
    scores[np.arange(160), np.arange(0, 8000, 50)] = -np.inf
    assert (np.sort(scores, axis=1)[:, -5:][:, ::-1] == best.score).all()


def test_what_is_not_pruned_is_scored_in_wide_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(4400, 64))
    points = np.floor(256 * points / np.linalg.norm(points, axis=1, keepdims=True))
    points[100:150] = points[7]  # ties
    ids, calls, offer = np.arange(4400), [], Best.offer
    monkeypatch.setattr(Best, "offer", lambda self, rows, scores, ids: (calls.append(scores.size), offer(self, rows, scores, ids))[1])
    best = Best(ids[:4400:11], 5)
    queries, data = CoverTree(points[::11]), CoverTree(points)
    assert cover_tree._scores(queries, data) is np.float32
    dual_search(queries, data, ids, best)
    assert len(calls) <= 20 and sum(calls) == 400 * 4400
    for q, i in enumerate(ids[::11].tolist()):
        want = sorted((-s, j) for j, s in enumerate((points @ points[i]).tolist()) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.score[q].tolist(), best.id[q].tolist())] == want


def test_single_precision_only_where_it_is_exact():
    long = CoverTree(np.array([[4096.0, 1.0], [4095.0, 2.0]]))
    assert cover_tree._scores(long, long) is np.float64
    best = Best(np.array([0, 1]), 1)
    dual_search(long, long, np.array([0, 1]), best)
    assert best.score.ravel().tolist() == [4096 * 4095 + 2] * 2
