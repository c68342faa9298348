import hashlib

from pyspark.sql import functions as F

from cohortlens.functions.scalars import (cutoff_grid, friendly_name, mean_of, pair_key, percent_label,
                                          right_closed_cut, seeded_key, seeded_uniform, signif, thousands)
from cohortlens.operators import aggregates as A


def test_right_closed_cut_edges(spark):
    df = spark.createDataFrame([(v,) for v in [17, 18, 25, 26, 55, 60, 61, 62]], "age int")
    lab = right_closed_cut("age", A.AGE_BREAKS, A.AGE_LABELS)
    got = [r[0] for r in df.select(lab).collect()]
    assert got == [None, "18-25", "18-25", "26-35", "46-55", "56-60", "56-60", None]


def test_open_last_bin(spark):
    df = spark.createDataFrame([(2,), (3,), (100,)], "t int")
    lab = right_closed_cut("t", A.TENURE_BREAKS, A.TENURE_LABELS)
    assert [r[0] for r in df.select(lab).collect()] == ["1-2", "2-5", "20+"]


def test_signif_and_pair(spark):
    df = spark.createDataFrame([(0.0123456, "b", "a")], "x double, p string, q string")
    r = df.select(signif("x", 3).alias("s"), pair_key("p", "q").alias("k")).first()
    assert abs(r.s - 0.0123) < 1e-12 and r.k == "a — b"


def test_seeded_uniform_portable(spark):
    df = spark.createDataFrame([(7,)], "id long")
    r = df.select(seeded_key(42, "id").alias("k"), seeded_uniform(42, "id").alias("u")).first()
    h = hashlib.md5(b"42:7").hexdigest()
    assert r.k == h and abs(r.u - int(h[:8], 16) / 2 ** 32) < 1e-15


def test_income_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 3000, 3001, 10000, 20000, 20001]], "x int")
    got = [r[0] for r in df.select(right_closed_cut("x", A.INCOME_BREAKS, A.INCOME_LABELS)).collect()]
    low, _, upper, high = A.INCOME_LABELS
    assert got == [None, low, low, A.INCOME_LABELS[1], upper, high, None]


def test_display_labels_and_composites(spark):
    df = spark.createDataFrame([(0.2347, 12345.6, "over_time_flag", 1.0, 2.0), (None, None, None, 1.0, None)],
                               "p double, x double, s string, a double, b double")
    r = df.select(percent_label("p"), thousands("x"), friendly_name("s"), mean_of("a", "b")).collect()
    assert tuple(r[0]) == ("23.5%", "12,346", "over time flag", 1.5)
    assert tuple(r[1]) == (None, None, None, None)


def test_cutoffs_are_exact_hundredths(spark):
    got = [r[0] for r in cutoff_grid(spark).orderBy("threshold").collect()]
    assert got == [k / 100 for k in range(5, 96)]


def test_mean_se_and_pivot(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "u", 3.0), ("a", "v", None), ("b", "v", 5.0)],
                               "m string, k string, x double")
    got = {r["m"]: (r["mean"], r["std_err"], r["n"]) for r in A.mean_se(df, ["m"], "x").collect()}
    assert got == {"a": (2.0, 1.0, 2), "b": (5.0, None, 1)}
    wide = {r["m"]: (r["u"], r["v"]) for r in A.mean_pivot(df, "m", "k", "x", ["u", "v"]).collect()}
    assert wide == {"a": (2.0, None), "b": (None, 5.0)}
