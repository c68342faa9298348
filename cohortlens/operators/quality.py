"""Data quality and profiling (Q1-Q14).

Rule of this module: k columns are folded into one scan - either one
multi-aggregate that is then stacked to long form, or one unpivot followed by
one grouped aggregate - never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_safe_join
from cohortlens.session import materialize
from cohortlens.operators.ordering import exact_quantiles
from cohortlens.sources.tables import columns_of_kind


def stack_scalars(row_df: DataFrame, names: Sequence[str], key: str, value: str,
                  prefix: str = "") -> DataFrame:
    """One-row wide aggregate -> long (key, value) rows via ``stack``."""
    args = ", ".join(f"'{n}', `{prefix}{n}`" for n in names)
    return row_df.selectExpr(f"stack({len(names)}, {args}) as (`{key}`, `{value}`)")


def long_values(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
                as_type: str = "double", var: str = "variable", val: str = "value") -> DataFrame:
    """Wide -> long over ``cols`` (cast to one type)."""
    cast = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), var, val)


def null_report(df: DataFrame) -> DataFrame:
    """Q1: NULL count per column plus an '(all columns)' total row, one scan."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    wide = wide.withColumn("(all columns)", sum((F.col(c) for c in cols), F.lit(0)))
    return stack_scalars(wide, cols + ["(all columns)"], "column_name", "n_null") \
        .select("column_name", F.col("n_null").cast("long").alias("n_null"))


def duplicate_rows(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Q2: rows beyond the first of each identical group (whole row, and on ``key``).

    Doubles get ``+ 0.0`` so -0.0 and 0.0 group together.  Each grouping is
    one shuffle with map-side partial counts, so hot groups collapse early.
    """
    norm = df.select(*[(F.col(f.name) + F.lit(0.0)).alias(f.name)
                       if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])
    whole = norm.groupBy(*norm.columns).count().agg(
        F.sum("count").alias("n_rows"), F.sum(F.col("count") - 1).alias("n_duplicate_rows"))
    if not key:
        return whole
    by_key = norm.groupBy(*key).count().agg(F.sum(F.col("count") - 1).alias("n_duplicate_keys"))
    return whole.withColumn("n_duplicate_keys", by_key.scalar())


def key_uniqueness(df: DataFrame, key: Sequence[str], table_name: str) -> DataFrame:
    """Q3: distinct key count vs row count."""
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct(*[F.col(k) for k in key]).alias("n_distinct"))
    return agg.select(F.lit(table_name).alias("table_name"), F.lit(",".join(key)).alias("key_cols"),
                      "n_rows", "n_distinct",
                      (F.col("n_rows") == F.col("n_distinct")).alias("is_unique"))


def cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q8: distinct values per column, NULL not counted: exact by default, by HyperLogLog++ with ``approx``.

    Exact counts group narrow (column, value) rows once, combined before the shuffle, and count
    the groups; no row carries the other columns.  -0.0 and 0.0 are one value.
    """
    if approx:
        wide = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in df.columns])
        return stack_scalars(wide, df.columns, "column_name", "n_distinct") \
            .select("column_name", F.col("n_distinct").cast("long").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    text = df.select(*[_as_text(f).alias(f.name) for f in df.schema.fields])
    values = text.unpivot([], df.columns, "column_name", "value").where(F.col("value").isNotNull()).distinct()
    counts = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return names.join(counts, "column_name", "left").select(
        "column_name", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def _as_text(field) -> Column:
    """A text that is the same for equal values only."""
    kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if kind in ("double", "float"):
        return (c + F.lit(0.0).cast(kind)).cast("string")
    if kind == "binary":
        return F.hex(c)
    nested = kind.startswith(("array", "map", "struct"))
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")))) if nested else c.cast("string")


def constant_columns(df: DataFrame) -> DataFrame:
    """Q9: columns whose values that are not NULL are all the same (min = max): one pass, no shuffle of rows."""
    wide = df.agg(*[F.when(F.min(c) == F.max(c), 1).otherwise(0).alias(c) for c in df.columns])
    return stack_scalars(wide, df.columns, "column_name", "n_distinct").where(F.col("n_distinct") == 1).select(
        "column_name", F.col("n_distinct").cast("long").alias("n_distinct"))


def freq_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q5/Q6: one-way counts and proportions for every categorical, one shuffle."""
    cols = list(cols or columns_of_kind(df, "categorical"))
    long = long_values(df, cols, as_type="string", val="level")
    counts = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, ["variable"], "n", "prop")


def with_share(counts: DataFrame, part_cols: Sequence[str], n_col: str = "n",
               name: str = "share") -> DataFrame:
    """N / sum(n) within ``part_cols`` (empty = grand total).

    Totals are a grouped aggregate joined back on the partition key (the
    totals table has one row per partition key; AQE broadcasts it when its
    measured size allows), so no window gathers a partition into one task.
    """
    part_cols = list(part_cols)
    if not part_cols:
        total = counts.agg(F.sum(n_col)).scalar()
        return counts.withColumn(name, F.col(n_col) / total)
    totals = counts.groupBy(*part_cols).agg(F.sum(n_col).alias("_tot"))
    return null_safe_join(counts, totals, part_cols).withColumn(
        name, F.try_divide(n_col, "_tot")).drop("_tot").select(*counts.columns, name)


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Q7: min, Q1, median, mean, Q3, max per numeric column (type-7 quantiles)."""
    cols = list(cols or columns_of_kind(df, "numeric"))
    long = long_values(df, cols)
    if approx:
        q = exact_quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75], approx=True)
        basic = long.groupBy("variable").agg(F.min("value").alias("min"), F.avg("value").alias("mean"),
                                             F.max("value").alias("max"))
        q = q.join(basic, "variable")
    else:
        # min / mean / max ride along in the quantile operator's first pass
        q = exact_quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75], with_stats=True)
    def at(p):
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))
    return q.groupBy("variable").agg(F.first("min").alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"),
                                     F.first("mean").alias("mean"), at(0.75).alias("q3"),
                                     F.first("max").alias("max"))


def quartiles(long: DataFrame, k: float = 1.5, approx: bool = False) -> DataFrame:
    """Type-7 quartiles and Tukey fences per variable, one quantile-operator call."""
    q = exact_quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75], approx=approx)

    def at(p):
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))
    w = q.groupBy("variable").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    # one row per variable, of known size for the join of the counting pass
    return materialize(w.withColumn("lo", F.col("q1") - k * iqr).withColumn("hi", F.col("q3") + k * iqr), "fences")


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5,
                 approx: bool = False) -> DataFrame:
    """Q10: strict-fence outlier count and percent (1 decimal), most first.

    The fences table has one row per variable; AQE broadcasts it into the
    counting pass."""
    long = long_values(df, cols)
    f = quartiles(long, k, approx)
    out = (long.join(f, "variable")
           .groupBy("variable")
           .agg(F.sum(((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).cast("long"))
                .alias("outliers"),
                F.count("value").alias("_n")))
    return out.select("variable", "outliers",
                      F.round(F.col("outliers") * 100.0 / F.col("_n"), 1).alias("pct_outliers")) \
        .orderBy(F.desc("outliers"), "variable")


def box_stats(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences), outlier count."""
    long = long_values(df, cols)
    f = quartiles(long, 1.5, approx)
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    agg = (long.join(f, "variable").groupBy("variable", "q1", "median", "q3")
           .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
                F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
                F.sum((~inside).cast("long")).alias("n_outliers")))
    return agg.select("variable", "whisker_lo", "q1", "median", "q3", "whisker_hi", "n_outliers")


def range_violations(df: DataFrame, rules: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Q13: rows outside each documented domain ``(rule, column, lo, hi)``; one scan."""
    aggs = [F.sum(((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).cast("long")).alias(name)
            for name, c, lo, hi in rules]
    wide = df.agg(*aggs)
    long = stack_scalars(wide, [r[0] for r in rules], "rule", "n_violations")
    meta = df.sparkSession.createDataFrame(
        [(n, c, float(lo), float(hi)) for n, c, lo, hi in rules],
        "rule string, column_name string, lo double, hi double")
    return meta.join(long, "rule").select("rule", "column_name", "lo", "hi",
                                          F.col("n_violations").cast("long").alias("n_violations"))


def drop_columns(df: DataFrame, *groups: Sequence[str]) -> DataFrame:
    """Drop identifier, constant and derived columns."""
    names = [c for g in groups for c in g]
    return df.drop(*names)


def noise_screen(df: DataFrame, suspects: Sequence[str], reference: str, outcome: str = "y") -> DataFrame:
    """Q12: r with a reference measure and r with the outcome, per suspect column."""
    aggs = []
    for s in suspects:
        aggs += [F.corr(s, reference).alias(f"{s}__ref"), F.corr(s, outcome).alias(f"{s}__y")]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{s}', `{s}__ref`, `{s}__y`" for s in suspects)
    return wide.selectExpr(f"stack({len(suspects)}, {args}) as (variable, cor_with_reference, cor_with_outcome)")
