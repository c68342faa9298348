"""Order-dependent primitives that never gather a group into one task.

A window with ``partitionBy(class)`` or ``partitionBy(model)`` sends a whole
class or model to one task; a third of all rows may sit in one class.  The
two primitives here keep every task bounded:

* ``running_sums`` - inclusive running sums (and exact ranks) within groups,
  ordered by unique keys: range-partition on (group, key), sum inside each
  range with a vectorised pandas cumsum, add per-range offsets computed on a
  table that has one row per (range, group).
* ``exact_quantiles`` - type-7 (linear) quantiles, exact, from an approximate
  sketch bracket plus an exact count of the values inside the bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.scalars import null_safe_join
from cohortlens.session import ensure_checkpoint_dir, materialize

_PID = "_range_id"


#: Rows of one range, the most that a task holds at once.
ROWS_PER_RANGE = 100_000


def ranges_for(df: DataFrame) -> int:
    """Ranges by the rows of the input, whatever the session's shuffle partitions."""
    return max(1, math.ceil(df.count() / ROWS_PER_RANGE))


def running_sums(df: DataFrame, part_cols: Sequence[str], order: Sequence[Column],
                 sum_cols: Sequence[str], suffix: str = "_cum",
                 n_ranges: int | None = None) -> DataFrame:
    """Add ``<c><suffix>`` = sum of c over rows of the same group up to this row.

    ``order`` must give a strict total order inside each group (append an id
    for ties); descending order is expressed with ``Column.desc()``.  One plan
    at every size: no task ever holds more than one range.  NULL group keys
    form a group, NULL values add nothing, and a running sum is NULL until the
    first value that is not NULL, as in SQL.
    """
    part_cols, sum_cols = list(part_cols), list(sum_cols)
    sort_spec = [F.col(c) for c in part_cols] + list(order)
    n = n_ranges or ranges_for(df)
    ranged = (df.repartitionByRange(n, *sort_spec)
              .sortWithinPartitions(*sort_spec)
              .withColumn(_PID, F.spark_partition_id()))
    names = [c + "_local" for c in sum_cols] + [c + "_seen" for c in sum_cols]
    out_schema = T.StructType(ranged.schema.fields + [
        T.StructField(c, T.DoubleType(), False) for c in names])

    def local_cumsum(batches):
        # Rows arrive sorted by (group, order) inside the range, so groups are
        # contiguous: group ids come from key changes (vectorised), and only a
        # batch's first group can continue the previous batch's last group.
        last_key, last_tot = None, None
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{c: pd.Series(dtype="float64") for c in names})
                continue
            raw = pdf[sum_cols].astype("float64")
            vals = np.hstack([raw.fillna(0.0).to_numpy(), raw.notna().to_numpy().astype("float64")])
            changed = np.zeros(len(pdf), dtype=bool)
            changed[0] = True
            for c in part_cols:
                codes, _ = pd.factorize(pdf[c])  # NULL is one code of its own
                changed[1:] |= codes[1:] != codes[:-1]
            gid = np.cumsum(changed)
            cums = pd.DataFrame(vals).groupby(gid).cumsum().to_numpy()
            keys = [[None if pd.isna(x) else x for x in pdf[part_cols].iloc[i]] for i in (0, -1)]
            if last_tot is not None and keys[0] == last_key:
                cums[gid == 1] += last_tot
            last_key, last_tot = keys[1], cums[-1].copy()
            for j, c_out in enumerate(names):
                pdf[c_out] = cums[:, j]
            yield pdf

    # Reliable checkpoint in the shared folder: both uses below read the same
    # materialised ranges, and a lost executor does not re-rank.
    ensure_checkpoint_dir(df.sparkSession)
    local = ranged.mapInPandas(local_cumsum, out_schema).checkpoint(eager=True)
    keys = [_PID] + part_cols
    totals = _range_totals(local, keys, sum_cols)
    w = (Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()).orderBy(_PID) \
        .rowsBetween(Window.unboundedPreceding, -1)
    # One row per (range, group): bounded by ranges + groups, so this small
    # window is cheap even when it is unpartitioned.
    offsets = totals.select(*keys, *[F.coalesce(F.sum(c + x).over(w), F.lit(0.0)).alias(c + x + "_off")
                                     for c in sum_cols for x in ("_tot", "_cnt")])
    joined = null_safe_join(local, offsets, keys)
    return joined.select(*df.columns, *[
        F.when(F.col(c + "_seen") + F.col(c + "_cnt_off") > 0, F.col(c + "_local") + F.col(c + "_tot_off"))
        .alias(c + suffix) for c in sum_cols])


def _range_totals(local: DataFrame, keys: Sequence[str], sum_cols: Sequence[str]) -> DataFrame:
    """Sum and count of non-NULL values per (range, group)."""
    v = {c: F.col(c).cast("double") for c in sum_cols}
    return local.groupBy(*keys).agg(*[F.coalesce(F.sum(v[c]), F.lit(0.0)).alias(c + "_tot") for c in sum_cols],
                                    *[F.count(v[c]).cast("double").alias(c + "_cnt") for c in sum_cols])


def exact_ranks(df: DataFrame, part_cols: Sequence[str], order: Sequence[Column],
                name: str = "rank0", n_ranges: int | None = None) -> DataFrame:
    """0-based ``row_number() - 1`` within groups, computed without a group-wide window."""
    one = "_one"
    r = running_sums(df.withColumn(one, F.lit(1.0)), part_cols, order, [one], n_ranges=n_ranges)
    return r.withColumn(name, (F.col(one + "_cum") - 1).cast("long")).drop(one, one + "_cum")


def exact_quantiles(long_df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], accuracy: int = 20000,
                    approx: bool = False, with_stats: bool = False, margin: float | None = None) -> DataFrame:
    """Type-7 quantiles per group as ``(group..., prob, quantile)`` rows.

    Pass 1 (one aggregate): n, min, mean, max and a percentile sketch of
    relative rank error 1/accuracy at p -/+ 3/accuracy, which brackets the
    two order statistics each quantile interpolates (groups of at most
    4*accuracy rows use [min, max] instead).  Pass 2: rows are matched to
    their group's brackets; rows below a bracket are only counted, rows
    inside are counted per distinct value, and only those candidates (at
    most ~6n/accuracy values, or n <= 4*accuracy for small groups) are
    ordered.

    The result (groups x probs rows) is written, and a quantile whose ranks fall
    outside their bracket, should a sketch err more than it states, is found again
    in one 16 times as wide (``margin``), at last between minimum and maximum.

    The pass-1 table has one row per group and is written once, so its size is
    known to the join.  The candidates of one (group, probability), at most
    6/accuracy of the group, are ranked by one window.  NULL group keys form a
    group.  ``approx=True`` returns the sketch value alone;
    ``with_stats`` adds n, min, mean and max per group.
    """
    group_cols = list(group_cols)
    v = F.col(value_col).cast("double")
    base = long_df.select(*group_cols, v.alias("_v")).where(F.col("_v").isNotNull())
    probs = [float(p) for p in probs]
    if approx:
        q = base.groupBy(*group_cols).agg(
            F.percentile_approx("_v", probs, accuracy).alias("_q"))
        return q.select(*group_cols, F.posexplode("_q").alias("_i", "quantile")).select(
            *group_cols, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
            .alias("prob"), "quantile")
    margin = 3.0 / accuracy if margin is None else margin
    lo_p = [max(0.0, p - margin) for p in probs]
    hi_p = [min(1.0, p + margin) for p in probs]
    stats = base.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
        F.avg("_v").alias("_mean"), F.percentile_approx("_v", lo_p + hi_p, accuracy).alias("_b"))
    stats = materialize(stats, "quantile_stats")
    k = len(probs)
    # Below 4*accuracy rows the sketch margin is under one rank, so such a
    # group is bracketed by [min, max]: at most 4*accuracy candidate values.
    small = F.col("_n") <= F.lit(4 * accuracy)

    def lo(i):
        return F.when(F.lit(lo_p[i] <= 0) | small, F.col("_mn")).otherwise(F.element_at("_b", i + 1))

    def hi(i):
        return F.when(F.lit(hi_p[i] >= 1) | small, F.col("_mx")).otherwise(F.element_at("_b", k + i + 1))

    # brackets per group as arrays in prob order (lower ends are non-decreasing)
    sk = ["_n", "_mn", "_mx", "_mean"]
    br = stats.select(*group_cols, *sk, F.array(*[lo(i) for i in range(k)]).alias("_los"),
                      F.array(*[hi(i) for i in range(k)]).alias("_his"))
    keyed = null_safe_join(base, br, group_cols)
    # ONE row per input row: j = number of lower bracket ends <= v (so v < lo_i
    # exactly when j < i), and the value itself only when it lies in a bracket.
    x = F.col("_v")
    j = sum((x >= F.col("_los")[i]).cast("int") for i in range(k))
    inside = None
    for i in range(k):
        c = (x >= F.col("_los")[i]) & (x <= F.col("_his")[i])
        inside = c if inside is None else inside | c
    counted = keyed.groupBy(*group_cols, j.alias("_j"), F.when(inside, x).alias("_cv")) \
        .agg(F.count(F.lit(1)).alias("_c"))
    # per-prob brackets: a table of (groups x k) rows
    per_prob = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(p).alias("prob"),
                                  F.col("_los")[i].alias("_lo"), F.col("_his")[i].alias("_hi"))
                         for i, p in enumerate(probs)])
    brp = (br.select(*group_cols, *sk, F.explode(per_prob).alias("s"))
           .select(*group_cols, *sk, "s._i", "s.prob", "s._lo", "s._hi")
           .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("prob"))
           .withColumn("_k0", F.floor("_h").cast("long"))
           .withColumn("_k1", F.ceil("_h").cast("long")))
    bkeys = group_cols + ["prob", "_k0", "_k1", "_h", "_n", "_mn", "_mx", "_mean"]
    # the aggregate has (k+1) bucket rows per group plus one row per candidate value
    pair = null_safe_join(counted, brp, group_cols)
    below = (pair.where(F.col("_j") < F.col("_i")).groupBy(*bkeys).agg(F.sum("_c").alias("_c"))
             .select(*bkeys, F.lit(-1).alias("_side"), F.lit(None).cast("double").alias("_cv"), "_c"))
    cands = pair.where(F.col("_cv").isNotNull() & (F.col("_cv") >= F.col("_lo")) & (F.col("_cv") <= F.col("_hi"))) \
        .select(*bkeys, F.lit(0).alias("_side"), "_cv", "_c")
    counted = below.unionByName(cands)
    # One running count per (group, prob) ordered by (side, value): the single
    # "below" row comes first, so a candidate's running count is its rank bound.
    w = Window.partitionBy(*bkeys).orderBy("_side", "_cv").rowsBetween(Window.unboundedPreceding, 0)
    cum = counted.withColumn("_c_cum", F.sum("_c").over(w))
    ranked = (cum.where(F.col("_side") == 0)
              .withColumn("_hi_rank", F.col("_c_cum"))
              .withColumn("_lo_rank", F.col("_hi_rank") - F.col("_c")))

    def at(kc):
        hit = (F.col("_lo_rank") <= F.col(kc)) & (F.col(kc) < F.col("_hi_rank"))
        return F.max(F.when(hit, F.col("_cv")))

    res = ranked.groupBy(*bkeys).agg(at("_k0").alias("_v0"), at("_k1").alias("_v1"))
    res = materialize(res, "quantiles")
    missed = res.where(F.col("_v0").isNull() | F.col("_v1").isNull()).select(*group_cols, "prob")
    frac = F.col("_h") - F.col("_k0")
    extra = [F.col("_n").alias("n"), F.col("_mn").alias("min"), F.col("_mean").alias("mean"),
             F.col("_mx").alias("max")] if with_stats else []
    out = res.select(*group_cols, "prob",
                     (F.col("_v0") + frac * (F.col("_v1") - F.col("_v0"))).alias("quantile"), *extra)
    again = [r["prob"] for r in missed.select("prob").distinct().collect()]  # some of the few probabilities
    if not again:
        return out
    key = F.struct(*group_cols, F.lit(1)) if group_cols else F.struct(F.lit(1))
    groups = missed.select(key.alias("_g")).distinct()
    wider = exact_quantiles(long_df.join(groups, key.eqNullSafe(F.col("_g")), "left_semi"), group_cols, value_col, again,
                            accuracy, with_stats=with_stats, margin=max(margin, 1.0 / accuracy) * 16)
    kept = out.where(F.col("quantile").isNotNull())
    held = kept.select(F.struct(*group_cols, "prob").alias("_g"))
    return kept.unionByName(wider.join(held, F.struct(*group_cols, "prob").eqNullSafe(F.col("_g")), "left_anti"))
