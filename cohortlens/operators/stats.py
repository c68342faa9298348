"""Association statistics and distribution summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.scalars import null_safe_join, pair_key, scalar_fields
from cohortlens.operators import lockstep
from cohortlens.operators.ordering import exact_quantiles
from cohortlens.operators.quality import long_values
from cohortlens.session import materialize


def pearson_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full correlation matrix in long form (var1, var2, correlation).

    Every task adds up the Gramian of its rows, batch by batch, and one tree of sums
    reduces them, so work and plan stay linear in rows for any number of columns.
    A pair counts the rows where both are present, as SQL ``corr`` does; values are
    taken from the columns' means, found before, which keeps the moments accurate.
    A pair without variance has correlation NULL, the diagonal is 1.
    """
    cols, p = list(cols), len(cols)
    num = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = num.agg(*[F.avg(c).alias(c) for c in num.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def add(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]) - shift
            # NULL arrives as NaN; a NaN or infinite value of the column itself counts as absent too
            here = np.isfinite(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            total += [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
        yield lockstep.vectors({0: total.ravel()})

    rows = num.mapInArrow(add, lockstep.VECTORS)
    found = lockstep.tree_sum(rows, num.rdd.getNumPartitions())
    n, s, q, c = found[0].reshape(4, p, p) if found else np.zeros((4, p, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        var = q - s * s / n
        r = (c - s * s.T / n) / np.sqrt(var * var.T)
    flat = var <= 1e-14 * q
    r = np.where(flat | flat.T | ~np.isfinite(r), np.nan, np.clip(r, -1.0, 1.0))
    out = [(a, b, 1.0 if a == b else (None if np.isnan(r[i, j]) else float(r[i, j])))
           for i, a in enumerate(cols) for j, b in enumerate(cols)]  # one row a pair of columns
    return df.sparkSession.createDataFrame(out, "var1 string, var2 string, correlation double")


def strong_pairs(df: DataFrame, cols: Sequence[str], cutoff: float = 0.70) -> DataFrame:
    """Distinct unordered pairs with |r| >= cutoff, strongest first."""
    long = pearson_long(df, cols).where(F.col("var1") < F.col("var2"))
    return (long.where(F.abs("correlation") >= cutoff)
            .withColumn("pair", pair_key("var1", "var2"))
            .orderBy(F.desc(F.abs("correlation"))))


def point_biserial(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """T4: r of every numeric with the 0/1 outcome, |r| and rank by |r|."""
    wide = df.agg(*[F.corr(c, outcome).alias(c) for c in cols])
    args = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {args}) as (variable, r_pb)")
    # metric-sized table (one row per column): a global ordering is cheap here
    return long.withColumn("abs_r", F.abs("r_pb")).orderBy(F.desc("abs_r"))


def chi_square(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """Pearson chi-square (no continuity correction) and Cramer's V.

    Cell counts come from one unpivot + aggregate; margins are joined back
    from per-variable aggregates; expected counts use the dense grid of
    observed levels x outcome classes so zero cells contribute their e.
    """
    long = long_values(df, cols, ids=[outcome], as_type="string", val="level")
    cells = long.groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("row_n"),
        *[F.count(F.when(F.col(outcome) == k, 1)).alias(f"o{k}") for k in (0, 1)])
    # margins are sums of the cells: the input is read once
    cells = materialize(cells, "cells")
    classes = cells.groupBy("variable").agg(
        F.sum("row_n").alias("n"), *[F.sum(f"o{k}").alias(f"c{k}") for k in (0, 1)])
    j = cells.join(classes, "variable")
    term = None
    for k in (0, 1):
        e = F.col("row_n") * F.col(f"c{k}") / F.col("n")
        t = F.when(e > 0, (F.col(f"o{k}") - e) * (F.col(f"o{k}") - e) / e).otherwise(F.lit(0.0))
        term = t if term is None else term + t
    agg = j.groupBy("variable", "n").agg(F.sum(term).alias("chi_sq"),
                                         F.count(F.lit(1)).alias("n_levels"),
                                         F.max(F.when(F.col("c0") > 0, 1).otherwise(0)
                                               + F.when(F.col("c1") > 0, 1).otherwise(0)).alias("n_classes"))
    k_min = F.least(F.col("n_levels"), F.col("n_classes"))
    return agg.select(
        "variable", "chi_sq",
        ((F.col("n_levels") - 1) * (F.col("n_classes") - 1)).alias("dof"),
        F.col("n").alias("n"),
        F.round(F.sqrt(F.try_divide("chi_sq", F.col("n") * (k_min - 1))), 3).alias("cramers_v"))


def chi_square_asymptotic(df: DataFrame, cols: Sequence[str], outcome: str = "y") -> DataFrame:
    """Asymptotic p-values via ``pyspark.ml.stat.ChiSquareTest`` (no Yates)."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    idx_cols = [c + "_idx" for c in cols]
    ind = StringIndexer(inputCols=list(cols), outputCols=idx_cols).fit(df).transform(df)
    vec = VectorAssembler(inputCols=idx_cols, outputCol="_features").transform(ind)
    res = ChiSquareTest.test(vec.select("_features", F.col(outcome).cast("double").alias("_label")),
                             "_features", "_label", flatten=True)
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "featureIndex int, variable string")
    return res.join(names, "featureIndex").select(
        "variable", F.col("statistic").alias("chi_sq"), F.col("degreesOfFreedom").alias("dof"),
        F.col("pValue").alias("p_value"))


#: Simulations drawn from one copy of a variable's margins.
SIM_BLOCK = 100


def mc_pvalue(df: DataFrame, cols: Sequence[str], outcome: str = "y", b: int = 2000,
              seed: int = 2024, alpha: float = 0.05, n_partitions: int | None = None) -> DataFrame:
    """Monte-Carlo p-value with both margins fixed, p = (1 + #{sim >= obs}) / (B + 1).

    Each simulated table is drawn cell-row by cell-row from a multivariate
    hypergeometric over the column margins, so a draw costs O(r*c) and not
    O(n).  A variable's margins travel once for every SIM_BLOCK of its B simulations;
    those blocks are rows spread over partitions, drawn in a pandas function.
    """
    long = long_values(df, cols, ids=[outcome], as_type="string", val="level")
    cells = long.groupBy("variable", "level").agg(
        *[F.count(F.when(F.col(outcome) == k, 1)).alias(f"o{k}") for k in (0, 1)])
    margins = cells.groupBy("variable").agg(
        # one row per level, in level order: the draws must not depend on arrival
        F.transform(F.array_sort(F.collect_list(F.struct("level", F.array("o0", "o1").alias("o")))),
                    lambda x: x["o"]).alias("table"))
    sims = margins.select("variable", "table",
                          F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(SIM_BLOCK))).alias("sim"))
    nparts = n_partitions or len(cols) * -(-b // SIM_BLOCK)
    sims = sims.repartition(nparts, "variable", "sim")
    schema = T.StructType([T.StructField("variable", T.StringType()),
                           T.StructField("sim", T.IntegerType()),
                           T.StructField("chi_sq_obs", T.DoubleType()),
                           T.StructField("chi_sq_sim", T.DoubleType())])

    def simulate(batches):
        for pdf in batches:
            for table, var, first in zip(pdf["table"], pdf["variable"], pdf["sim"]):
                tab = np.array([list(r) for r in table], dtype=np.int64)
                sims = np.arange(first, min(first + SIM_BLOCK, b), dtype="int32")
                drawn = [_chi2(_fixed_margin_table(np.random.default_rng([seed, int(i), _stable_hash(var)]),
                                                   tab.sum(1), tab.sum(0))) for i in sims]
                yield pd.DataFrame({"variable": var, "sim": sims, "chi_sq_obs": _chi2(tab), "chi_sq_sim": drawn})

    res = sims.mapInPandas(simulate, schema)
    out = res.groupBy("variable").agg(
        F.first("chi_sq_obs").alias("chi_sq"),
        ((F.sum((F.col("chi_sq_sim") >= F.col("chi_sq_obs") - 1e-9).cast("long")) + 1)
         / F.lit(float(b + 1))).alias("p_value"))
    return out.withColumn("significant", F.when(F.col("p_value") < alpha, "Yes").otherwise("No"))


def _stable_hash(s: str) -> int:
    h = 0
    for ch in s.encode():
        h = (h * 131 + ch) % 2147483647
    return h


def _chi2(tab: np.ndarray) -> float:
    n = tab.sum()
    e = np.outer(tab.sum(1), tab.sum(0)) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(e > 0, (tab - e) ** 2 / e, 0.0)
    return float(t.sum())


def _fixed_margin_table(rng, row_sums, col_sums) -> np.ndarray:
    remaining = np.array(col_sums, dtype=np.int64)
    out = np.zeros((len(row_sums), len(col_sums)), dtype=np.int64)
    for i, r in enumerate(row_sums):
        if i == len(row_sums) - 1:
            out[i] = remaining
            break
        draw = rng.multivariate_hypergeometric(remaining, int(r))
        out[i] = draw
        remaining = remaining - draw
    return out


def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] with empty bins kept.

    Edges come from scalar subqueries (min, max); the dense (bin[, class])
    grid is a ``range`` of fixed size, left-joined to the counts.
    """
    spark = df.sparkSession
    x = F.col(col).cast("double")
    mm = scalar_fields(df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")))
    mn, mx = mm["mn"], mm["mx"]
    width = (mx - mn) / F.lit(float(bins))
    # a constant column has width 0: all its rows are in the first bin
    idx = F.when(x.isNotNull(), F.least(F.coalesce(F.floor(F.try_divide(x - mn, width)), F.lit(0)),
                                        F.lit(bins - 1))).cast("int")
    keys = ["bin"] + ([by] if by else [])
    counts = df.select(idx.alias("bin"), *([F.col(by)] if by else [])) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if by:
        classes = df.select(by).distinct()
        grid = classes.select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    else:
        grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = null_safe_join(grid, counts, keys, "left").select(
        *keys, (mn + F.col("bin") * width).alias("bin_lo"),
        (mn + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out


def scatter_bins(df: DataFrame, x: str, y: str, by: str, bins: int = 20) -> DataFrame:
    """2-D binned point counts per class (the scalable form of a scatter)."""
    e = scalar_fields(df.agg(F.min(x).alias("xa"), F.max(x).alias("xb"), F.min(y).alias("ya"),
                             F.max(y).alias("yb")))
    xa, xb, ya, yb = e["xa"], e["xb"], e["ya"], e["yb"]

    def at(c, lo, hi):
        b = F.coalesce(F.floor(F.try_divide(F.col(c) - lo, (hi - lo) / bins)), F.lit(0))
        return F.when(F.col(c).isNotNull(), F.least(b, F.lit(bins - 1))).cast("int")

    bx, byy = at(x, xa, xb), at(y, ya, yb)
    return df.groupBy(bx.alias("x_bin"), byy.alias("y_bin"), F.col(by)) \
        .agg(F.count(F.lit(1)).alias("n"))


#: Width of a density bin in bandwidths, and Hermite polynomials of the expansion around its centre.
KDE_WIDTH = 1 / 32
_HERMITE = (lambda u: F.lit(1.0), lambda u: u, lambda u: u * u - 1, lambda u: u * (u * u - 3),
            lambda u: u * u * (u * u - 6) + 3, lambda u: u * (u * u * (u * u - 10) + 15))


def kde(df: DataFrame, value: str, group: str, grid_points: int = 64) -> DataFrame:
    """Gaussian kernel density per group on an even grid over the group's range.

    Bandwidth is Silverman's nrd0: 0.9 * min(sd, IQR/1.34) * n^(-1/5).  Rows are
    first summed into bins of KDE_WIDTH bandwidths, as their moments around the centre
    (one grouped sum combined map-side); a bin's part of a density is the Hermite
    expansion of the kernel at its centre, so no row meets a grid point.  With
    r = KDE_WIDTH / 2 the truncation error of a density is below
    1.09 * r^6 / sqrt(6!) / (1 - r) of the kernel's peak 1 / (bw * sqrt(2 * pi)): 6e-13 of it.
    A group has at most range / (bw * KDE_WIDTH) bins, and no empty ones.
    """
    q = exact_quantiles(df, [group], value, [0.25, 0.75])
    iqr = q.groupBy(group).agg((F.max(F.when(F.col("prob") == 0.75, F.col("quantile")))
                                - F.max(F.when(F.col("prob") == 0.25, F.col("quantile")))).alias("iqr"))
    st = df.groupBy(group).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"),
                               F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    bw = materialize(null_safe_join(st, iqr, [group]).withColumn(
        "bw", F.lit(0.9) * F.least(F.col("sd"), F.col("iqr") / F.lit(1.34)) * F.pow(F.col("n"), F.lit(-0.2))), "bandwidth")
    rows = null_safe_join(df.select(group, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull()), bw, [group])
    width = F.col("bw") * F.lit(KDE_WIDTH)
    # a constant group has bandwidth 0: one bin, and its density is NULL
    b = F.coalesce(F.floor(F.try_divide(F.col("_x") - F.col("lo"), width)), F.lit(0))
    e = F.try_divide(F.col("_x") - (F.col("lo") + (F.col("_b") + 0.5) * width), F.col("bw"))
    binned = (rows.withColumn("_b", b).withColumn("_e", e).groupBy(group, "_b")
              .agg(*[F.sum(F.pow("_e", F.lit(float(k))) / math.factorial(k)).alias(f"m{k}") for k in range(len(_HERMITE))]))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(grid_points - 1))
    j = null_safe_join(binned, bw, [group]).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
    j = j.withColumn("x", F.col("lo") + F.col("point") * step)
    j = j.withColumn("_u", F.try_divide(F.col("x") - (F.col("lo") + (F.col("_b") + 0.5) * width), F.col("bw")))
    u = F.col("_u")
    series = sum(F.col(f"m{k}") * he(u) for k, he in enumerate(_HERMITE))
    dens = F.try_divide(F.exp(F.lit(-0.5) * u * u) * series, F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))
    return j.groupBy(group, "point").agg(F.first("x").alias("x"), F.sum(dens).alias("density"))
