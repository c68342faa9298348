"""Gramian, binned density, re-bracketed quantiles and range counts against plain versions."""
import math

import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions.scalars import seeded_uniform
from cohortlens.operators import ordering as O
from cohortlens.operators import stats as S


def numbers(spark, n, cols, partitions=5):
    return spark.range(n, numPartitions=partitions).select("id", *[
        (seeded_uniform(3, "id", F.lit(i)) * (i + 1) + 1e6 * (i % 2)).alias(f"x{i}") for i in range(cols)])


def test_gramian_equals_corr_with_nulls_constants_and_far_means(spark):
    df = numbers(spark, 700, 8).withColumns({
        "x2": F.when(F.col("id") % 7 > 0, F.col("x0") * 2 + F.col("x1")), "x3": F.lit(5.0),
        "x4": F.when(F.col("id") < 0, F.lit(1.0)), "x5": F.when(F.col("id") % 3 == 0, -F.col("x0"))})
    cols = [f"x{i}" for i in range(8)]
    got = {(r.var1, r.var2): r.correlation for r in S.pearson_long(df, cols).collect()}
    pdf = df.toPandas()
    assert len(got) == 64 and all(got[c, c] == 1.0 for c in cols)
    for a in cols:
        for b in cols:
            if a == b:
                continue
            both = pdf[[a, b]].dropna()
            flat = len(both) < 2 or both[a].nunique() < 2 or both[b].nunique() < 2
            assert (got[a, b] is None) == flat
            assert flat or abs(got[a, b] - np.corrcoef(both[a], both[b])[0, 1]) < 1e-9
    assert S.pearson_long(df.limit(0), cols[:2]).where("correlation = 1").count() == 2


def test_three_hundred_columns(spark):
    df = numbers(spark, 200, 300)
    x = np.array(df.orderBy("id").drop("id").toPandas())
    got = S.pearson_long(df, [f"x{i}" for i in range(300)]).toPandas().correlation.to_numpy().reshape(300, 300)
    assert np.abs(got - np.corrcoef(x.T)).max() < 1e-6


def test_binned_density_is_within_its_error(spark):
    df = numbers(spark, 3000, 1).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), "x0")
    pdf = df.toPandas()
    for (g,), rows in S.kde(df, "x0", "g", 32).toPandas().groupby(["g"]):
        v = pdf[pdf.g == g].x0.to_numpy()
        q = np.quantile(v, [0.25, 0.75])
        bw = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
        x = rows.x.to_numpy()
        want = np.exp(-0.5 * ((x[:, None] - v[None]) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert len(rows) == 32 and np.abs(rows.density.to_numpy() - want).max() <= 2e-12 / bw
    flat = S.kde(df.limit(40).withColumn("x0", F.lit(2.0)), "x0", "g", 4).collect()
    assert {r.density for r in flat} == {None}


def test_missed_brackets_are_found_again(spark):
    df = numbers(spark, 4000, 2).select(
        F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("g"), F.col("x0").alias("v"))
    pdf = df.toPandas()
    probs = [0.1, 0.25, 0.5, 0.9]
    # a sketch of 8 bins and brackets of no width miss nearly every rank
    got = {(r.g, r.prob): r.quantile for r in O.exact_quantiles(df, ["g"], "v", probs, accuracy=8, margin=0.0).collect()}
    assert len(got) == 12
    for g in (None, "0", "1"):
        v = pdf[pdf.g.isna() if g is None else pdf.g == g].v.to_numpy()
        assert all(abs(got[g, p] - np.quantile(v, p)) < 1e-12 for p in probs)
    whole = O.exact_quantiles(df, [], "v", probs, accuracy=8, margin=0.0, with_stats=True).collect()
    assert [abs(r.quantile - np.quantile(pdf.v, r.prob)) < 1e-12 and r.n == 4000 for r in whole] == [True] * 4


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 50)
    assert O.ranges_for(spark.range(100)) == 2 and O.ranges_for(spark.range(1000)) == 20 and O.ranges_for(spark.range(0)) == 1
    df = spark.range(1000).withColumn("one", F.lit(1.0))
    out = O.running_sums(df, [], [F.col("id").desc()], ["one"])
    assert out.where(F.col("one_cum") != 1000 - F.col("id")).count() == 0
