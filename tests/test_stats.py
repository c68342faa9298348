import math

from cohortlens.operators import quality as Q
from cohortlens.operators import stats as S


def test_chi_square_2x2_by_hand(spark):
    # g=a: 10 rows y=1, 30 y=0; g=b: 20 y=1, 40 y=0
    rows = [("a", 1)] * 10 + [("a", 0)] * 30 + [("b", 1)] * 20 + [("b", 0)] * 40
    df = spark.createDataFrame(rows, "g string, y int")
    r = S.chi_square(df, ["g"]).first()
    n, e = 100, {("a", 1): 40 * 30 / 100, ("a", 0): 40 * 70 / 100, ("b", 1): 60 * 30 / 100, ("b", 0): 60 * 70 / 100}
    o = {("a", 1): 10, ("a", 0): 30, ("b", 1): 20, ("b", 0): 40}
    chi = sum((o[k] - e[k]) ** 2 / e[k] for k in o)
    assert abs(r.chi_sq - chi) < 1e-9 and r.dof == 1
    assert abs(r.cramers_v - round(math.sqrt(chi / n), 3)) < 1e-9


def test_mc_pvalue_floor_and_range(spark):
    rows = [("a", 1)] * 40 + [("a", 0)] * 10 + [("b", 1)] * 5 + [("b", 0)] * 45
    df = spark.createDataFrame(rows, "g string, y int")
    r = S.mc_pvalue(df, ["g"], b=200).first()
    assert abs(r.p_value - 1 / 201) < 1e-12 and r.significant == "Yes"


def test_pearson_symmetric(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(-i)) for i in range(20)], "a double, b double, c double")
    m = {(r.var1, r.var2): r.correlation for r in S.pearson_long(df, ["a", "b", "c"]).collect()}
    assert all(abs(m[(x, y)] - m[(y, x)]) < 1e-12 for x in "abc" for y in "abc")
    assert abs(m[("a", "c")] + 1) < 1e-12


def test_iqr_outliers_strict(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = Q.iqr_outliers(df, ["x"]).first()
    assert r.outliers == 1 and r.pct_outliers == 20.0


def test_null_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 0.0), (2, -0.0)], "k int, v double")
    nr = {r.column_name: r.n_null for r in Q.null_report(df).collect()}
    assert nr == {"k": 0, "v": 2, "(all columns)": 2}
    d = Q.duplicate_rows(df, ["k"]).first()
    assert d.n_rows == 4 and d.n_duplicate_rows == 2 and d.n_duplicate_keys == 2
