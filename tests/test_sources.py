from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from cohortlens.sources.tables import read_metric_table, schema_report, write_table


def test_metric_table_roundtrip_prettifies(spark, tmp_path):
    df = spark.createDataFrame([("gradient_boosting", 0.84), ("random_forest", 0.83)], "model string, mean double")
    out = str(tmp_path / "cmp")
    write_table(df, out, fmt="csv")
    back = read_metric_table(spark, out, fmt="csv")
    assert sorted(r.model for r in back.collect()) == ["gradient boosting", "random forest"]


def test_schema_report_kinds(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k bigint, s string, x double")
    rep = {r.column_name: (r.data_type, r.kind, r.n_rows) for r in schema_report(df).collect()}
    assert rep == {"k": ("bigint", "numeric", 1), "s": ("string", "categorical", 1), "x": ("double", "numeric", 1)}


def test_cohort_filter_wildcards(spark):
    df = spark.createDataFrame([("Sales", 30, 1), ("R&D", 40, 0), ("Sales", 50, 0)], "dept string, age int, y int")
    assert A.cohort_filter(df, {"dept": "All"}, {"age": (18, 60)}).count() == 3
    assert A.cohort_filter(df, {"dept": "Sales"}, {"age": (18, 45)}).count() == 1
    s = A.cohort_summary(df, A.cohort_filter(df, {"dept": "Sales"}, {})).first()
    assert (s.n, s.n_positive, s.n_total, s.is_filtered) == (2, 1, 3, True)
    assert s.summary == "2 rows, 1 positive (50.0%) - filtered view 2 of 3"
