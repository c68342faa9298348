"""Outcome rates, shares, bins and cohorts.

Every operator is one grouped aggregate (partial/final HashAggregate, so a
hot key is combined map-side before the shuffle) plus, where needed, a join
to a per-partition total or a scalar subquery for one-row statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_safe_join, right_closed_cut
from cohortlens.operators.ordering import exact_quantiles, exact_ranks
from cohortlens.operators.quality import long_values, with_share
from cohortlens.session import materialize


def outcome_profile(df: DataFrame, means: dict[str, tuple[str, int]],
                    pct_flags: dict[str, Column], outcome: str = "y") -> DataFrame:
    """A1/A10: per outcome class: n, rounded means, percent of rows meeting a flag.

    ``means`` maps output name -> (column, decimals); ``pct_flags`` maps output
    name -> boolean expression (percent rounded to 1 decimal).
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.round(F.avg(c), d).alias(name) for name, (c, d) in means.items()]
    aggs += [F.round(F.avg(e.cast("double")) * 100.0, 1).alias(name) for name, e in pct_flags.items()]
    return df.groupBy(outcome).agg(*aggs)


def rate_by_category(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """A2: n and outcome rate per level of every categorical, highest rate first.

    All columns go through one unpivot and one shuffle.
    """
    long = long_values(df, cols, ids=[outcome], as_type="string", val="level")
    rates = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate"))
    return display_order(materialize(rates, "rates"), ["variable"], [F.desc("rate"), F.asc("level")])


def display_order(df: DataFrame, part_cols: Sequence[str], order: Sequence[Column],
                  name: str = "ord") -> DataFrame:
    """Explicit display rank of each category by a statistic, from 1.

    Ranks are counted over ranges, so the levels of one variable, however many,
    never meet in one task.  ``order`` is a strict order within ``part_cols``."""
    ranked = exact_ranks(df, part_cols, order, name="_rank")
    return ranked.select(*df.columns, (F.col("_rank") + 1).cast("int").alias(name))


def rate_with_reference(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """A3/Q11: A2 plus the overall rate (scalar subquery) and lift = rate / overall."""
    overall = df.agg(F.avg(outcome)).scalar()
    return (rate_by_category(df, cols, outcome)
            .withColumn("overall_rate", overall)
            .withColumn("lift", F.try_divide("rate", "overall_rate")))


def category_share(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """Share of each outcome class within each level (columns sum to 1)."""
    long = long_values(df, cols, ids=[outcome], as_type="string", val="level")
    counts = long.groupBy("variable", "level", outcome).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, ["variable", "level"], "n", "share")


def likert_share(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """Share of each ordinal value within each outcome class."""
    long = long_values(df, cols, ids=[outcome], as_type="long")
    counts = long.groupBy("variable", outcome, "value").agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, ["variable", outcome], "n", "share")


def grand_share(df: DataFrame, col: str) -> DataFrame:
    """Counts of ``col`` and their share of the grand total."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, [], "n", "share")


#: Levels in one row of the grid's blocks.
LEVEL_BLOCK = 1000


def dense_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """A4/A5: two-way counts including zero cells, long form (a, b, n); NULL is a level.

    Levels of ``b`` are dealt to blocks of LEVEL_BLOCK by their rank; every level
    of ``a`` meets every block by an equi-join on the block's number, so no list
    is longer than a block.  Counts are joined to that grid.
    """
    counts = materialize(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), "cells")
    levels = exact_ranks(counts.select(b).distinct(), [], [F.col(b)], name="_rank")
    blocks = materialize(levels.groupBy(F.floor(F.col("_rank") / LEVEL_BLOCK).alias("_block"))
                         .agg(F.collect_list(F.struct(b)).alias("_levels")), "level_blocks")
    n_blocks = max(1, blocks.count())
    grid = (counts.select(a).distinct()
            .select(a, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("_block"))
            .join(blocks, "_block")
            .select(a, F.explode("_levels").alias("_l")).select(a, F.col("_l")[b].alias(b)))
    return null_safe_join(grid, counts, [a, b], "left").select(
        a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def conditional_rates(df: DataFrame, rules: dict[str, Column], outcome: str = "y") -> DataFrame:
    """Outcome rate and count inside each rule's subset, all in ONE aggregate."""
    aggs = []
    for name, cond in rules.items():
        aggs += [F.avg(F.when(cond, F.col(outcome))).alias(f"{name}__rate"),
                 F.count(F.when(cond, F.lit(1))).alias(f"{name}__n")]
    wide = df.agg(*aggs)
    args = ", ".join(f"'{n}', `{n}__rate`, `{n}__n`" for n in rules)
    return wide.selectExpr(f"stack({len(rules)}, {args}) as (rule, rate, n)")


def binned_rate(df: DataFrame, specs: dict[str, tuple[Sequence[float], Sequence[str]]],
                outcome: str = "y") -> DataFrame:
    """Rate (percent, 1 decimal) and n per right-closed bin of each variable.

    Out-of-range values form the NULL bin, as R ``cut`` does.
    """
    bins = [F.struct(F.lit(var).alias("variable"), right_closed_cut(var, breaks, labels).alias("bin"))
            for var, (breaks, labels) in specs.items()]  # one scan for all variables
    long = df.select(F.explode(F.array(*bins)).alias("b"), outcome).select("b.variable", "b.bin", outcome)
    return (long.groupBy("variable", "bin")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(outcome) * 100.0, 1).alias("rate_pct")))


# Tenure bins of the dashboard (right-closed, last open).
TENURE_BREAKS = [-1, 1, 2, 5, 10, 20, float("inf")]
TENURE_LABELS = ["0-1", "1-2", "2-5", "5-10", "10-20", "20+"]
# EDA age and income bins.
AGE_BREAKS = [17, 25, 35, 45, 55, 61]
AGE_LABELS = ["18-25", "26-35", "36-45", "46-55", "56-60"]
INCOME_BREAKS = [0, 3000, 6000, 10000, 20000]
INCOME_LABELS = ["Low (<3K)", "Mid (3-6K)", "Upper-Mid (6-10K)", "High (10K+)"]


def tenure_curve(df: DataFrame, col: str, outcome: str = "y") -> DataFrame:
    """Rate and n per tenure bin (0-1, 1-2, 2-5, 5-10, 10-20, 20+)."""
    b = right_closed_cut(col, TENURE_BREAKS, TENURE_LABELS)
    return df.groupBy(b.alias("tenure_bin")).agg(F.avg(outcome).alias("rate"),
                                                 F.count(F.lit(1)).alias("n"))


def cohort_filter(df: DataFrame, equals: dict[str, str], ranges: dict[str, tuple[float, float]],
                  wildcard: str = "All") -> DataFrame:
    """Conjunctive filter where a wildcard value disables a clause.

    Clauses fold into one predicate, which Catalyst pushes into the scan.
    """
    cond = F.lit(True)
    for c, v in equals.items():
        if v != wildcard:
            cond = cond & (F.col(c) == F.lit(v))
    for c, (lo, hi) in ranges.items():
        cond = cond & (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))
    return df.where(cond)


def cohort_kpis(cohort: DataFrame, mean_cols: dict[str, str], outcome: str = "y") -> DataFrame:
    """N, outcome rate and means for a filtered cohort in one aggregate."""
    return cohort.agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate"),
                      *[F.avg(c).alias(n) for n, c in mean_cols.items()])


def cohort_summary(full: DataFrame, cohort: DataFrame, outcome: str = "y") -> DataFrame:
    """N, positives, rate, population size, filtered flag and a sentence."""
    total = full.agg(F.count(F.lit(1))).scalar()
    s = cohort.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias("n_positive"))
    s = s.withColumn("n_total", total) \
        .withColumn("rate_pct", F.round(F.try_divide(F.col("n_positive") * 100.0, F.col("n")), 1)) \
        .withColumn("is_filtered", F.col("n") < F.col("n_total"))
    sentence = F.concat(F.col("n").cast("string"), F.lit(" rows, "),
                        F.col("n_positive").cast("string"), F.lit(" positive ("),
                        F.coalesce(F.col("rate_pct").cast("string"), F.lit("NA")), F.lit("%)"),
                        F.when(F.col("is_filtered"),
                               F.concat(F.lit(" - filtered view "), F.col("n").cast("string"),
                                        F.lit(" of "), F.col("n_total").cast("string")))
                        .otherwise(F.lit("")))
    return s.withColumn("summary", sentence)


def group_median(df: DataFrame, group: str, value: str, approx: bool = False) -> DataFrame:
    """Exact median of ``value`` per group (no group is gathered in one task)."""
    med = exact_quantiles(df, [group], value, [0.5], approx=approx) \
        .select(group, F.col("quantile").alias("median_" + value))
    return materialize(med, "medians")  # one row per group, of known size for the joins


def group_median_flag(df: DataFrame, group: str, value: str, factor: float = 0.8) -> DataFrame:
    """Rows below ``factor`` x their group's median, per group.

    The per-group medians (one row per group) are attached by an equi-join;
    AQE broadcasts them when their measured size is below the threshold.
    """
    med = group_median(df, group, value)
    j = null_safe_join(df.select(group, value), med, [group])
    return (j.groupBy(group, "median_" + value)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum((F.col(value) < F.lit(factor) * F.col("median_" + value)).cast("long"))
                 .alias("n_below")))


def group_bands(df: DataFrame, group: str, value: str, lo_factor: float = 0.8, hi_factor: float = 1.2,
                lowest: float | None = None, highest: float | None = None) -> DataFrame:
    """Per-group min/max band widened (floor(min*0.8), ceil(max*1.2)), kept within lowest and highest."""
    lo, hi = F.floor(F.min(value) * lo_factor), F.ceil(F.max(value) * hi_factor)
    if lowest is not None:
        lo = F.greatest(lo, F.lit(lowest).cast("long"))
    if highest is not None:
        hi = F.least(hi, F.lit(highest).cast("long"))
    return df.groupBy(group).agg(lo.alias("band_lo"), hi.alias("band_hi"))


def group_value_rows(df: DataFrame, group: str, value: str) -> DataFrame:
    """Every distinct value of each group as a row, with its position in the group from 1.

    For groups of any number of values: ranks are counted over ranges and no group's
    values are gathered.  NULL values are no values; a NULL group is a group."""
    pairs = df.where(F.col(value).isNotNull()).select(group, value).distinct()
    return display_order(materialize(pairs, "group_values"), [group], [F.asc(value)], name="position")


def values_per_group(df: DataFrame, group: str, value: str, sep: str = ",") -> DataFrame:
    """A14 as the display's text: sorted distinct values per group in one string (collect_set dedups
    map-side).  The string holds a group's values by nature; ``group_value_rows`` is the form
    for groups of many values."""
    return df.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set(value)), sep).alias("values"),
        F.count_distinct(value).alias("n_values"))


def mean_se(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error and n of a metric over resamples."""
    return df.groupBy(*group_cols).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_err"),
        F.count(value).alias("n"))


def mean_pivot(df: DataFrame, row: str, key: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean of ``value`` per (row, key), keys pivoted to columns (fixed list)."""
    return df.groupBy(row).pivot(key, list(keys)).agg(F.avg(value))
