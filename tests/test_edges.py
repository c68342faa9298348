"""NULLs, empty and constant inputs, one-class groups, hostile level names, missing parents."""
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_safe_join
from cohortlens.operators import aggregates as A
from cohortlens.operators import decisions as D
from cohortlens.operators import evaluate as EV
from cohortlens.operators import features as FE
from cohortlens.operators import ordering as O
from cohortlens.operators import quality as Q
from cohortlens.operators import smote as SM
from cohortlens.operators import splits as SP
from cohortlens.operators import stats as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def constant(spark):
    return spark.range(0, 20).select("id", F.lit(3.0).alias("x"), F.lit("a").alias("c"), (F.col("id") % 2).alias("y"))


def test_null_groups_and_values_in_running_sums(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 2}", None if i % 3 == 0 else 1.0) for i in range(60)],
                               "id long, g string, w double")
    r = O.running_sums(df, ["g"], [F.col("id")], ["w"], n_ranges=4)
    sql = df.selectExpr("*", "sum(w) OVER (PARTITION BY g ORDER BY id ROWS UNBOUNDED PRECEDING) AS w_cum")
    assert sorted(map(tuple, r.collect()), key=repr) == sorted(map(tuple, sql.collect()), key=repr)


def test_null_outcomes_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "id long, y int")
    assert SP.stratified_split(df).count() == 100
    assert SP.repeated_folds(df).count() == 300


def test_null_group_in_quantiles_and_medians(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, v double")
    assert {r["g"]: r["quantile"] for r in O.exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {None: 2.0, "a": 5.0}
    assert {r["g"]: r["n"] for r in A.group_median_flag(df, "g", "v").collect()} == {None: 2, "a": 2}


def test_constant_column_statistics(constant):
    assert {r["bin"]: r["n"] for r in ST.histogram(constant, "x", bins=4).collect()} == {0: 20, 1: 0, 2: 0, 3: 0}
    assert [r["n"] for r in ST.scatter_bins(constant, "x", "x", "y").collect()] == [10, 10]
    assert {r["density"] for r in ST.kde(constant, "x", "y", 4).collect()} == {None}
    assert {r["cramers_v"] for r in ST.chi_square(constant, ["c"]).collect()} == {None}
    assert {r["x"] for r in FE.standardize(constant, ["x"]).collect()} == {None}
    assert {r["column_name"] for r in Q.constant_columns(constant).collect()} == {"x", "c"}


def test_one_class_groups(spark):
    p = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.8), (None, 0, 0.4), (None, 1, 0.6)], "model string, y int, score double")
    assert {r["model"]: r["roc_auc"] for r in EV.roc_auc(p).collect()} == {"m": None, None: 1.0}
    assert {r["fpr"] for r in EV.roc_curve(p).where("model = 'm' AND threshold IS NOT NULL").collect()} == {None}
    spec = EV.threshold_sweep(p).where("model = 'm' AND metric = 'specificity'")
    assert spec.count() == 91 and {r["estimate"] for r in spec.collect()} == {None}


def test_empty_cohort(constant):
    r = A.cohort_summary(constant, constant.where("id < 0")).first()
    assert r["n"] == 0 and r["rate_pct"] is None and "NA" in r["summary"]


def test_levels_with_nulls_and_quotes(spark):
    df = spark.createDataFrame([("it's", None, 1), ("it's", "b`c", 0), (None, "b`c", 1)], "a string, b string, y int")
    got = {(r["a"], r["b"]): r["n"] for r in A.dense_contingency(df, "a", "b").collect()}
    assert got == {("it's", None): 1, ("it's", "b`c"): 1, (None, "b`c"): 1, (None, None): 0}
    share = {(r["level"], r["y"]): r["share"] for r in A.category_share(df, ["a"]).collect()}
    assert share == {("it's", 1): 0.5, ("it's", 0): 0.5, (None, 1): 1.0}


def test_null_inputs_are_not_clamped(spark):
    df = spark.createDataFrame([(1, None), (2, 9)], "id int, v int")
    out = {r["id"]: (r["v"], r["n_changed"]) for r in D.clamp_cascade(
        df, [("v", lambda: F.lit(0), lambda: F.lit(3))]).collect()}
    assert out == {1: (None, 0), 2: (3, 1)}


@pytest.mark.parametrize("minority", [1, 3])
def test_smote_makes_every_copy_it_owes(spark, minority):
    df = spark.createDataFrame([(i, [float(i), 1.0], int(i < minority)) for i in range(40)], "id long, x array<double>, y int")
    out = SM.smote(df, "id", "x", "y", over_ratio=0.8, k=5).collect()
    assert len(out) == int((40 - minority) * 0.8) - minority


def test_nominal_with_near_zero_variance_is_dropped_from_the_recipe(spark):
    from cohortlens.operators.tuning import Recipe, fit_recipe
    df = spark.range(0, 200).select("id", (F.col("id") * 1.0).alias("x"), F.when(F.col("id") == 7, "rare").otherwise("often").alias("c"),
                                    F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("d"), (F.col("id") % 2).cast("int").alias("y"))
    model = fit_recipe(df, Recipe(numeric=["x"], categorical=["c", "d"]))
    assert len(model.transform(df).first()["features"]) == 2


def test_level_only_in_held_out_rows_fits_when_declared(spark):
    from cohortlens.operators.features import categorical_levels
    from cohortlens.operators.tuning import Recipe, fit_recipe
    df = spark.createDataFrame([(i, float(i), "abc"[i % 3] if i < 30 else "d", i % 2) for i in range(31)], "id long, x double, c string, y int")
    train, held = df.where("id < 30"), df.where("id = 30")
    rc = Recipe(numeric=["x"], categorical=["c"], use_nzv=False, levels=categorical_levels(df, ["c"]))
    model = fit_recipe(train, rc)
    assert rc.levels == {"c": ["a", "b", "c", "d"]}
    assert len(model.transform(train).first()["features"]) == 1 + 3
    assert len(model.transform(held).first()["features"]) == 1 + 3


def test_repair_of_employee_inputs(spark):
    cols = "Department string, JobRole string, JobLevel int, MonthlyIncome int, Age int, TotalWorkingYears int, " \
           "YearsAtCompany int, YearsInCurrentRole int, YearsWithCurrManager int, YearsSinceLastPromotion int, NumCompaniesWorked int"
    pop = spark.createDataFrame([("Sales", "Manager", 5, 19000, 50, 30, 10, 5, 5, 5, 3), ("HR", "Clerk", 1, 1100, 30, 5, 2, 1, 1, 1, 1)], cols)
    bad = spark.createDataFrame([("Sales", "Clerk", 5, 50000, 50, 30, 10, 5, 5, 5, 3), ("HR", "Clerk", 1, 10, 30, 50, 50, 50, 50, 50, 50)], cols)
    out = {r["Department"]: r for r in D.repair_employees(bad, pop).collect()}
    assert out["Sales"]["JobRole"] == "Manager" and not out["Sales"]["JobRole_was_valid"]
    assert out["Sales"]["MonthlyIncome"] == 19999 and out["HR"]["MonthlyIncome"] == 1009
    assert out["HR"]["TotalWorkingYears"] == 14 and out["HR"]["NumCompaniesWorked"] == 9


def test_null_safe_join_keeps_columns(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("k", 20)], "k string, w int")
    out = null_safe_join(a, b, ["k"])
    assert out.columns == ["k", "v", "w"] and {(r["v"], r["w"]) for r in out.collect()} == {(1, 10), (2, 20)}


def test_orphan_orders_are_rejected_and_a_replayed_batch_writes_once(spark, tmp_path):
    from cohortlens.sources.tables import read_table
    from cohortlens.streaming import score_stream as S
    orders = read_table(spark, SF, "orders").limit(50)
    odd = orders.limit(1).withColumn("o_custkey", F.lit(-1).cast("long")).withColumn("o_orderkey", F.lit(-5).cast("long"))
    st, side = S.static_sides(spark, SF)
    lines = S.line_summary(spark, SF)
    for _ in range(2):
        S.write_batch(orders.unionByName(odd), 0, spark, SF, str(tmp_path), st, side, lines)
    assert spark.read.parquet(os.path.join(tmp_path, "scored")).count() == 50
    assert [r["id"] for r in spark.read.parquet(os.path.join(tmp_path, "rejects")).collect()] == [-5]


def test_declared_levels_of_unequal_number_fit(spark):
    from cohortlens.operators.features import categorical_levels
    from cohortlens.operators.tuning import Recipe, fit_recipe
    df = spark.createDataFrame([(i, float(i), "abc"[i % 3], "wxyz"[i % 4], i % 2) for i in range(48)],
                               "id long, x double, c string, d string, y int")
    rc = Recipe(numeric=["x"], categorical=["c", "d"], use_nzv=False, levels=categorical_levels(df, ["c", "d"]))
    out = fit_recipe(df, rc).transform(df)
    assert len(out.first()["features"]) == 1 + 2 + 3
    raw = {(r["c"], r["d"]): r["raw_features"].toArray().tolist()[1:] for r in out.collect()}
    assert raw[("a", "w")] == [0] * 5 and sum(raw[("c", "z")]) == 2  # the first level of each is the reference
