"""Whitening against exact arithmetic and numpy's symmetric solver."""
import random
from decimal import Context, Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import whitening as W

SF = "/root/testdata/sf0.001"


def table(spark, rows, **extra):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def check(df, ids, vectors, k=32, tol=1e-9):
    """Rows against eigenvectors of the covariance of floor(64 c) + 1000000, up to signs of distinct eigenvalues."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s).astype(np.float64)) / n
    lam = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    rank = int((lam > 1e-9 * max(lam[0], 1e-300)).sum()) if lam[0] > 0 else 0
    rows = df.collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, min(k, rank) + 1))
    dev = sorted((i, int(d)) for i, d in zip(ids, ((n * x - s) ** 2).sum(axis=1)))
    for comp, rs in by.items():
        assert sorted((r["vec_id"], int(r["deviation"])) for r in rs) == dev and {r["n"] for r in rs} == {n}
        assert abs(rs[0]["explained"] / (lam[comp - 1] / lam.sum()) - 1) < tol
        assert rs[0]["identity_error"] < tol
        assert abs(np.mean([r["whitened"] ** 2 for r in rs]) - 1) < tol
    return by, c, lam


def test_query_on_the_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    by, c, lam = check(W.op11_whitening(spark, SF), e.vec_id.tolist(), e.embedding.tolist())
    _, u = np.linalg.eigh(c.T @ c / len(c))
    at = {i: k for k, i in enumerate(e.vec_id)}
    for comp, rs in by.items():
        want = c @ u[:, -comp] / np.sqrt(lam[comp - 1])
        got = np.array([r["whitened"] for r in sorted(rs, key=lambda r: at[r["vec_id"]])])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9


def test_polynomial_equals_exact_one(spark):
    rng = random.Random(5)
    b = [[rng.randint(-9, 9) for _ in range(5)] for _ in range(7)]
    b = [row + [0, row[0]] for row in b]  # a zero column and a repeated one
    a = [[sum(r[i] * r[j] for r in b) for j in range(7)] for i in range(7)]
    c, m = [Fraction(1)], [[Fraction(0)] * 7 for _ in range(7)]  # Faddeev-LeVerrier
    for k in range(1, 8):
        for i in range(7):
            m[i][i] += c[-1]
        m = [[sum(a[i][x] * m[x][j] for x in range(7)) for j in range(7)] for i in range(7)]
        c.append(-sum(m[i][i] for i in range(7)) / k)
    assert W.characteristic_polynomial(spark, a) == [int(x) for x in reversed(c)]


def test_roots_are_counted_and_separated():
    poly = [1]
    for root in (3, 3, 3, 10, 1000, 1001, 0, 0):
        poly = [-root * x + y for x, y in zip(poly + [0], [0] + poly)]
    roots, s = W.largest_roots(poly, 8)
    assert [(round((a + b) / 2 / 2 ** s, 9), n) for a, b, n in roots] == [(1001, 1), (1000, 1), (10, 1), (3, 3)]
    assert [len(g) for g in W.bundles(roots)] == [1, 1, 1, 1] and len(W.largest_roots(poly, 2)[0]) == 2
    assert W.largest_roots([0, 0, 1], 3) == ([], 0)


@pytest.mark.parametrize("gap", [10 ** 8, 1])
def test_close_and_equal_eigenvalues(spark, gap):
    big = 10 ** 30  # roots big + gap, big twice, big - gap
    a = [[big, gap, 0, 0], [gap, big, 0, 0], [0, 0, big, 0], [0, 0, 0, big]]
    found = W.components(spark, a, 4)
    u = np.array([v for _, v in found])
    assert np.abs(u @ u.T - np.eye(4)).max() < 1e-14
    assert all(abs(int(e) - big) <= gap + 1 for e, _ in found)
    if gap > 1:  # no double tells these eigenvalues apart, their vectors are still those of the exact matrix
        assert int(found[0][0].quantize(Decimal(1), context=Context(prec=60))) == big + gap
        assert abs(u[0, 0] - u[0, 1]) < 1e-14 and abs(u[3, 0] + u[3, 1]) < 1e-14 and abs(abs(u[0, 0]) - 0.5 ** 0.5) < 1e-14


@pytest.mark.parametrize("name", ["repeated", "rank", "isotropic", "large"])
def test_shapes_of_data(spark, name):
    rng = np.random.default_rng(7)
    v = {"repeated": np.repeat(rng.standard_normal((9, 5)), 4, axis=0), "rank": rng.standard_normal((6, 12)),
         "isotropic": np.vstack([np.eye(6), -np.eye(6)]), "large": rng.standard_normal((40, 4)) * 1e9}[name]
    v = v.astype(np.float32)
    df = table(spark, [(i // 2, [float(x) for x in row]) for i, row in enumerate(v)])
    check(W.whiten(W.clean(df), k=4), [i // 2 for i in range(len(v))], v.tolist(), k=4, tol=1e-7)


def test_edges(spark, clash):
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, -3.0], [4.0, 4.0, 4.0], [4.0, 4.0, 4.0], [-2.5, 0.0, 1.0]]
    rows = [(1, good[0]), (None, good[1]), (2, good[2]), (2, good[3]), (3, good[4]), (4, None), (5, [1.0, None, 2.0]),
            (6, [1.0, float("nan"), 2.0]), (7, [1.0, float("inf"), 2.0]), (8, [1.0]), (9, [])]
    extra = {**clash, "v": 1, "component": 2, "whitened": 3, "deviation": 4}
    out = W.whiten(W.clean(table(spark, rows, **extra)))
    check(out.withColumn("vec_id", F.coalesce("vec_id", F.lit(0))), [1, 0, 2, 2, 3], good)
    for none in ([], [(1, good[0])], [(i, good[0]) for i in range(5)], [(1, None)]):
        df = W.whiten(W.clean(table(spark, none)))
        assert df.collect() == [] and df.columns == out.columns
    assert W.exact_gram(np.array([[1 << 60, -3], [-(1 << 61), 5]])).tolist() == [
        [(1 << 120) + (1 << 122), -3 * (1 << 60) - 5 * (1 << 61)], [-3 * (1 << 60) - 5 * (1 << 61), 34]]
