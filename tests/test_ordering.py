import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.operators.ordering import exact_quantiles, exact_ranks, running_sums


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_match_type7(spark, xs):
    df = spark.createDataFrame([(1, float(x)) for x in xs], "g int, v double")
    q = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    exp = np.quantile(np.array(xs, dtype=float), [0.0, 0.25, 0.5, 0.75, 1.0])
    assert np.allclose([q[p] for p in (0.0, 0.25, 0.5, 0.75, 1.0)], exp)


def test_quantiles_large_group_uses_bracket(spark):
    # more rows than 4 * accuracy: the sketch bracket path
    df = spark.range(0, 5000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 5000).cast("double").alias("v"))
    q = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], accuracy=500).collect()}
    exp = np.quantile(np.arange(5000, dtype=float), [0.1, 0.5, 0.9])
    assert np.allclose([q[0.1], q[0.5], q[0.9]], exp)


def test_exact_ranks_within_groups(spark):
    df = spark.range(0, 300).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 101).alias("k"))
    r = exact_ranks(df, ["g"], [F.col("k"), F.col("id")], n_ranges=5).toPandas()
    for _, sub in r.groupby("g"):
        s = sub.sort_values(["k", "id"])
        assert list(s.rank0) == list(range(len(s)))


def test_hot_group_is_spread_over_ranges(spark):
    """A group with 90% of the rows still ends up in many range partitions."""
    df = spark.range(0, 4000).select("id", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"))
    r = exact_ranks(df, ["g"], [F.col("id")], n_ranges=8)
    hot = r.where("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot >= 4
    ranks = sorted(x[0] for x in r.where("g = 'hot'").select("rank0").collect())
    assert ranks == list(range(3600))


def test_running_sums_desc(spark):
    df = spark.createDataFrame([("m", float(i), 1.0) for i in range(10)], "m string, s double, w double")
    r = running_sums(df, ["m"], [F.col("s").desc()], ["w"], n_ranges=3).toPandas().sort_values("s")
    assert list(r.w_cum) == [10.0 - i for i in range(10)]


def test_quantiles_of_two_groups(spark):
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 31) % 997).cast("double").alias("v"))
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.3, 0.5]).collect()}
    pdf = df.toPandas()
    for g, sub in pdf.groupby("g"):
        exp = np.quantile(sub.v.values, [0.3, 0.5])
        assert np.allclose([got[(g, 0.3)], got[(g, 0.5)]], exp)


def test_range_path_carries_across_arrow_batches(spark):
    """Groups that span several Arrow batches inside one range keep exact sums."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 500).select("id", (F.col("id") % 3).alias("g"), F.lit(2.0).alias("w"))
        r = running_sums(df, ["g"], [F.col("id")], ["w"], n_ranges=3).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for _, sub in r.groupby("g"):
        s = sub.sort_values("id")
        assert list(s.w_cum) == [2.0 * (i + 1) for i in range(len(s))]
