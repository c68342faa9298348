"""Column-expression helpers (P4, P9-P16, P19-P20, N20). All JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_SEP = " — "  # fixed value: "a — b" pair key separator


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(predicate: Column) -> Column:
    """Boolean -> 0/1 int."""
    return F.when(predicate, F.lit(1)).otherwise(F.lit(0))


def right_closed_cut(c, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """R ``cut``: (b0,b1] -> labels[0], ...; outside every interval -> NULL.

    Bucketizer is left-closed, so the CASE form is used instead.
    """
    if len(labels) != len(breaks) - 1:
        raise ValueError("need len(breaks) - 1 labels")
    x = col_of(c)
    expr = None
    for lo, hi, lab in zip(breaks[:-1], breaks[1:], labels):
        cond = x > F.lit(lo) if hi == float("inf") else (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def signif(c, digits: int) -> Column:
    """Round to ``digits`` significant digits (0 stays 0)."""
    x = col_of(c).cast("double")
    scale = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, F.lit(0.0)).otherwise(
        F.round(x * F.pow(F.lit(10.0), scale)) / F.pow(F.lit(10.0), scale))


def clamp(c, lo, hi) -> Column:
    """max(min(x, hi), lo); NULL bounds are ignored (Spark least/greatest skip NULL)."""
    return F.greatest(F.least(col_of(c), col_of(hi) if not _is_num(hi) else F.lit(hi)),
                      col_of(lo) if not _is_num(lo) else F.lit(lo))


def _is_num(v) -> bool:
    return isinstance(v, (int, float))


def pair_key(a, b, sep: str = PAIR_SEP) -> Column:
    """Canonical unordered pair label."""
    return F.concat_ws(sep, F.least(col_of(a), col_of(b)), F.greatest(col_of(a), col_of(b)))


def seeded_key(seed, *parts) -> Column:
    """Portable pseudo-random order key: md5 of 'seed:part1:part2...'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col_of(p).cast("string") for p in parts]))


def seeded_uniform(seed, *parts) -> Column:
    """Uniform in [0,1) from the first 8 hex digits of ``seeded_key``."""
    h = F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(4294967296.0)


def percent_label(c, accuracy: int = 1) -> Column:
    """0.2345 -> '23.5%' (accuracy = decimals)."""
    return F.concat(F.format_number(col_of(c) * 100.0, accuracy), F.lit("%"))


def thousands(c) -> Column:
    """12345.6 -> '12,346'."""
    return F.format_number(F.round(col_of(c)).cast("double"), 0)


def friendly_name(c) -> Column:
    """snake_case identifiers -> words."""
    return F.regexp_replace(col_of(c), "_", " ")


def mean_of(*cols) -> Column:
    """Composite mean of k scales."""
    total = None
    for c in cols:
        total = col_of(c) if total is None else total + col_of(c)
    return total / F.lit(float(len(cols)))


def cutoff_grid(spark, lo_pct: int = 5, hi_pct: int = 95):
    """Thresholds lo..hi in steps of 0.01 built from integers (no float drift)."""
    return spark.range(lo_pct, hi_pct + 1).select((F.col("id") / F.lit(100.0)).alias("threshold"))


def scalar_fields(one_row):
    """All columns of a one-row aggregate as literals, computed with ONE action.

    Separate scalar subqueries (one per field) are planned and executed one
    by one, each re-reading the input; fetching the single aggregated row
    once - as a Spark ML estimator does when it fits means or deviations -
    runs the aggregate exactly once and leaves a subquery-free plan.
    Only one row ever reaches the driver.
    """
    row = one_row.limit(2).collect()
    if len(row) != 1:
        raise ValueError("scalar_fields needs a one-row aggregate")
    types = dict(one_row.dtypes)
    return {c: F.lit(row[0][c]).cast(types[c]) for c in one_row.columns}


def null_safe_join(left, right, keys, how="inner"):
    """Equi-join on ``keys`` in which NULL matches NULL; the keys of ``left`` are kept."""
    keys = list(keys)
    own = {k: f"_right_{k}" for k in keys}
    r = right.select(*[F.col(k).alias(own[k]) for k in keys], *[c for c in right.columns if c not in own])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(own[k]))
    return left.join(r, cond, how).drop(*own.values())
