"""Level tables of any size: ranks, grids and lists that no single task holds; the CSV hand-off."""
import math

from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from cohortlens.operators import quality as Q
from cohortlens.operators import stats as S
from cohortlens.sources.tables import read_csv, write_table


def test_display_order_ranks_over_ranges(spark, monkeypatch):
    import cohortlens.operators.ordering as O
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 7)
    df = spark.range(60).selectExpr("IF(id < 50, 'hot', NULL) AS variable", "CAST(id AS string) AS level", "id % 5 AS rate")
    got = A.display_order(df, ["variable"], [F.desc("rate"), F.asc("level")]).collect()
    assert len(got) == 60
    for v in ("hot", None):
        rows = sorted((r for r in got if r.variable == v), key=lambda r: (-r.rate, r.level))
        assert [r.ord for r in rows] == list(range(1, len(rows) + 1))


def test_dense_grid_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "LEVEL_BLOCK", 2)
    rows = [("x", 1), ("x", 1), ("y", 2), (None, 3), ("y", None), ("x", 5), ("x", 6)]
    got = {(r.a, r.b): r.n for r in A.dense_contingency(spark.createDataFrame(rows, "a string, b int"), "a", "b").collect()}
    assert got == {(a, b): rows.count((a, b)) for a in ("x", "y", None) for b in (1, 2, 3, 5, 6, None)}
    assert A.dense_contingency(spark.createDataFrame([], "a string, b int"), "a", "b").count() == 0


def test_group_value_rows(spark):
    df = spark.createDataFrame([("g", 3), ("g", 1), ("g", 3), (None, 2), ("g", None), ("h", None)], "k string, v int")
    got = sorted(map(tuple, A.group_value_rows(df, "k", "v").collect()), key=str)
    assert got == sorted([("g", 1, 1), ("g", 3, 2), (None, 2, 1)], key=str)


def test_cardinality_of_every_type(spark):
    df = spark.createDataFrame(
        [(1, 0.0, [1, 2], ("a", 1), b"\x00", None), (2, -0.0, [1, 2], ("a", 2), b"\x01", None),
         (None, math.nan, [12], None, None, None), (2, math.nan, None, ("a", 1), b"\x00", None)],
        "i int, d double, l array<int>, s struct<p:string,q:int>, b binary, n string")
    got = {r.column_name: r.n_distinct for r in Q.cardinality(df).collect()}
    assert got == {"i": 2, "d": 2, "l": 2, "s": 2, "b": 2, "n": 0}
    assert {r.n_distinct for r in Q.cardinality(df.limit(0)).collect()} == {0}


def test_constant_columns_are_found(spark):
    df = spark.createDataFrame([(1, "a", None, 7), (2, "a", None, None), (3, "a", 5, 7)], "v int, c string, w int, u int")
    assert sorted(r.column_name for r in Q.constant_columns(df).collect()) == ["c", "u", "w"]


def test_draws_do_not_depend_on_the_block(spark, monkeypatch):
    df = spark.range(300).selectExpr("CAST(id % 4 AS string) AS c", "CAST(id % 7 < 3 AS int) AS y")
    want = S.mc_pvalue(df, ["c"], b=250).collect()
    monkeypatch.setattr(S, "SIM_BLOCK", 7)
    assert S.mc_pvalue(df, ["c"], b=250).collect() == want


def test_csv_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5), (3, "", 0.1)], "k int, s string, x double")
    write_table(df, str(tmp_path / "t"), fmt="csv")
    assert sorted(read_csv(spark, str(tmp_path / "t"), df.schema).collect()) == sorted(df.collect())
