"""Exact and approximate vector search: brute force, recall, ties, hot vectors, edges."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common, prefix_forest, topk
from cohortlens.llm.vectors import valid_vectors

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = x @ x[list(ids).index(i)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, rows, **extra):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.mark.parametrize("n,distinct", [(300, 300), (300, 7)])
def test_topk_equals_brute_force(spark, n, distinct):
    rng = np.random.default_rng(n + distinct)
    v = rng.integers(-90, 90, (distinct, 12))[rng.integers(0, distinct, n)]
    rows = spark.createDataFrame([(i, [int(c) for c in v[i]]) for i in range(n)], "vec_id long, c array<bigint>")
    got = found(topk.top_k(rows, F.col("vec_id") % 20 == 0, 5, rows_per_block=64, queries_per_block=4))
    assert got == brute(np.arange(n), v, range(0, n, 20), 5)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_lists_are_read_by_position_and_stay_exact(kind):
    rng = np.random.default_rng(3)
    ids = rng.permutation(2000)
    spread = rng.integers(-30, 30, (2000, 8))
    skewed = spread * np.array([30, 4, 1, 1, 1, 1, 1, 1])
    shares = {}
    for name, x in (("spread", spread), ("skewed", skewed), ("ties", spread // 16)):
        x = x.astype(kind)
        at = np.arange(0, 2000, 100)
        own = ids[at, None] == ids[None]
        read = 0
        for q, rows, scores, entries in topk.Lists(x).best(x[at], own, ids, 5):
            s = x @ x[at[q]]
            want = [r for r in np.lexsort((ids, -s)) if not own[q, r]][:5]
            assert rows.tolist() == want and scores.tolist() == s[want].tolist()
            read += entries
        shares[name] = read / (len(at) * x.size)
    assert shares["skewed"] < 0.6 and shares["skewed"] < shares["spread"] <= 1
    assert list(topk.Lists(x[:1]).best(x[:1], np.array([[True]]), ids[:1], 5)) == []
    assert [len(r) for _, r, _, _ in topk.Lists(x[:2]).best(x[:1], np.zeros((1, 2), bool), ids[:2], 5)] == [2]
    over_least, over_last, _ = topk.Lists(skewed).read(100)  # nothing is known of entries not read
    assert ((over_least != 0).sum(axis=0) <= 100).all() and ((over_last != 0).sum(axis=0) <= 100).all()


def test_forest_recall_against_brute_force(spark):
    t = common.embeddings(spark, SF).orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in t]), np.array([r["embedding"] for r in t], dtype=float)
    want = brute(ids, x, [i for i in ids.tolist() if i % 20 == 0], 20)
    v = valid_vectors(common.embeddings(spark, SF), nonzero=True)
    got = found(prefix_forest.nearest(v, F.col("vec_id") % 20 == 0, quota=60))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = found(prefix_forest.op6_prefix_forest(spark, SF))
    assert {q: [i for i, _ in r] for q, r in exact.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_planned_forest_holds_recall_on_a_larger_table():
    n, rng = 200_000, np.random.default_rng(5)
    trees, quota, rows = prefix_forest.plan(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ask = np.arange(0, n, n // 40)
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -2
    near = np.argpartition(-s, 20, axis=1)[:, :20]
    hit = np.zeros(near.shape, bool)
    for planes in np.split(prefix_forest._planes(trees, 64, 3).astype(np.float32), trees):
        keys = prefix_forest.hash_strings(x, np.zeros(n, np.float32), planes)[:, 0]
        order = np.argsort(keys)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        for i, q in enumerate(ask):  # a task sees its range partition only
            a = place[q] // rows * rows
            lo, hi = prefix_forest.descend(keys[order[a:a + rows]], keys[q:q + 1], quota)
            hit[i] |= (place[near[i]] >= a + lo[0]) & (place[near[i]] < a + hi[0])
    assert hit.mean() >= 0.9


def test_plan_follows_the_size_and_bounds_the_quota():
    assert prefix_forest.plan(51_282) == (32, 1200, 16_384) and prefix_forest.plan(640_000) == (32, 10_000, 80_000)
    trees, quota, rows = prefix_forest.plan(1 << 24)
    assert quota == 16_384 and rows == 131_072 and trees == 169


def test_forest_is_planned_by_the_different_vectors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(prefix_forest, "plan", lambda n: seen.append(n) or (2, n, 16_384))
    v = np.random.default_rng(4).normal(size=(150, 6)).astype(np.float32)
    v[100:] = v[:50]
    got = found(prefix_forest.nearest(valid_vectors(table(spark, [(i, v[i].tolist()) for i in range(150)])),
                                      F.col("vec_id") % 20 == 0, 5))
    want = brute(np.arange(150), v.astype(float), range(0, 150, 20), 5)
    assert seen == [100] and {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_forest_ties_and_one_hot_vector(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[50:150] = v[50]
    got = found(prefix_forest.nearest(valid_vectors(table(spark, [(i, v[i].tolist()) for i in range(200)], ids=1, key=2)),
                                      F.col("vec_id") % 10 == 0, 20))
    assert [i for i, _ in got[60]] == [i for i in range(50, 71) if i != 60]
    assert all(len(r) == 20 and q not in {i for i, _ in r} for q, r in got.items())


def test_forest_asks_once_for_equal_query_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(120, 6)).astype(np.float32)
    v[20:60] = v[20]
    v[100] = v[40]
    t = valid_vectors(table(spark, [(i, v[i].tolist()) for i in range(120)]))
    got = found(prefix_forest.nearest(t, F.col("vec_id") % 20 == 0, 5, quota=120))
    want = brute(np.arange(120), v.astype(float), range(0, 120, 20), 5)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_descend_stops_at_the_longest_sufficient_prefix():
    keys = np.sort(np.array([0b0001, 0b0010, 0b0011, 0b1000], np.uint64) << np.uint64(60))
    lo, hi = prefix_forest.descend(keys, np.array([0b0011], np.uint64) << np.uint64(60), 2)
    assert (lo[0], hi[0]) == (1, 3)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]),
            (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (50, [2.0, 1.0])]
    t = table(spark, rows, rank=1, score=2, query_id=3)
    assert {r["vec_id"] for r in valid_vectors(t).collect()} == {0, 5, 6, 50}
    op6 = found(prefix_forest.nearest(valid_vectors(t, nonzero=True), F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in r] for q, r in op6.items()} == {0: [50, 6]}
    c = valid_vectors(t).select("vec_id", F.transform("v", lambda x: F.floor(256 * x)).alias("c"))
    assert found(topk.top_k(c, F.col("vec_id") % 50 == 0)) == {
        0: [(50, 131072), (6, 32768), (5, 0)], 50: [(0, 131072), (6, 98304), (5, 0)]}
    none = table(spark, [])
    assert prefix_forest.nearest(valid_vectors(none, nonzero=True), F.col("vec_id") % 20 == 0).count() == 0
    empty = valid_vectors(none).select("vec_id", F.col("v").cast("array<bigint>").alias("c"))
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
