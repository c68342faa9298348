"""Evaluation algebra over a predictions table ``(group..., id, y, score)``.

Curves and rank-based AUC need cumulative counts in score order.  Rows are
first collapsed to one row per distinct (group, score) (a partial-aggregated
groupBy), then ``running_sums`` produces the cumulative counts with range
partitioning, so no model's predictions are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_safe_join, scalar_fields
from cohortlens.operators.ordering import running_sums

SCORE, Y = "score", "y"


def _collapsed(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    return pred.groupBy(*groups, SCORE).agg(
        F.sum(F.col(Y).cast("double")).alias("n1"),
        F.sum((1 - F.col(Y)).cast("double")).alias("n0"))


def cumulative_counts(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per distinct score (descending): n1, n0, cum1/cum0 = counts with score >= s, totals P/N."""
    groups = list(groups)
    c = _collapsed(pred, groups)
    cum = running_sums(c, groups, [F.col(SCORE).desc()], ["n1", "n0"])
    # totals = the last running value of each group: read from the
    # checkpointed sums instead of scanning the predictions again
    totals = cum.groupBy(*groups).agg(F.max("n1_cum").alias("P"), F.max("n0_cum").alias("N"))
    if groups:
        return null_safe_join(cum, totals, groups)
    t = scalar_fields(totals)
    return cum.withColumn("P", t["P"]).withColumn("N", t["N"])


def roc_curve(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """One point per distinct score plus the (0, 0) start (threshold NULL)."""
    groups = list(groups)
    cc = cumulative_counts(pred, groups)
    pts = cc.select(*groups, F.col(SCORE).alias("threshold"),
                    F.try_divide("n1_cum", "P").alias("tpr"),
                    F.try_divide("n0_cum", "N").alias("fpr"))
    start = pred.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return pts.unionByName(start)


def pr_curve(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """recall/precision per distinct score, plus (recall 0, precision 1) start."""
    groups = list(groups)
    cc = cumulative_counts(pred, groups)
    pts = cc.select(*groups, F.col(SCORE).alias("threshold"),
                    F.try_divide("n1_cum", "P").alias("recall"),
                    F.try_divide(F.col("n1_cum"), F.col("n1_cum") + F.col("n0_cum")).alias("precision"))
    start = pred.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"))
    return pts.unionByName(start)


def pr_baseline(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """The prevalence line of the PR plot, the precision of a random ranking."""
    return pred.groupBy(*groups).agg(F.avg(F.col("y").cast("double")).alias("prevalence"))


def roc_auc(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Rank-sum (Mann-Whitney) AUC with tie-averaged ranks.

    AUC = sum_s n1(s) * (#neg below s + n0(s)/2) / (P * N).
    """
    groups = list(groups)
    cc = cumulative_counts(pred, groups)
    below = F.col("N") - F.col("n0_cum")
    return cc.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("n1") * (below + F.lit(0.5) * F.col("n0"))), F.first("P") * F.first("N"))
        .alias("roc_auc"))


def _cut_index(score, lo: int = 0, hi: int = 100):
    """Largest k in [lo-1, hi] with k/100.0 <= score (exact at binary boundaries)."""
    k = F.floor(score * 100).cast("int")
    k = F.when(score >= (k + 1) / F.lit(100.0), k + 1).when(score < k / F.lit(100.0), k - 1).otherwise(k)
    return F.least(F.greatest(k, F.lit(lo - 1)), F.lit(hi))


def threshold_counts(pred: DataFrame, groups: Sequence[str] = ("model",), lo_pct: int = 5,
                     hi_pct: int = 95) -> DataFrame:
    """TP/FN/FP/TN at every cut-off lo..hi/100 with ``score >= t`` positive.

    Each prediction falls into one of at most 102 score buckets, so the
    pass over the predictions is one grouped count; the cumulative sums then
    run over (group x <=102) rows - a metric-sized table.
    """
    groups = list(groups)
    b = pred.select(*groups, _cut_index(F.col(SCORE), lo_pct, hi_pct).alias("k"), Y) \
        .groupBy(*groups, "k").agg(F.sum(F.col(Y).cast("double")).alias("n1"),
                                   F.sum((1 - F.col(Y)).cast("double")).alias("n0"))
    grid = pred.select(*groups).distinct().select(
        *groups, F.explode(F.sequence(F.lit(lo_pct - 1), F.lit(hi_pct))).alias("k"))
    dense = null_safe_join(grid, b, groups + ["k"], "left").na.fill(0.0, ["n1", "n0"])
    w = Window.partitionBy(*groups).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy(*groups)
    cum = dense.select(*groups, "k", F.sum("n1").over(w).alias("tp"), F.sum("n0").over(w).alias("fp"),
                       F.sum("n1").over(wt).alias("P"), F.sum("n0").over(wt).alias("N"))
    return cum.where(F.col("k") >= lo_pct).select(
        *groups, (F.col("k") / F.lit(100.0)).alias("threshold"), "tp", "fp",
        (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))


def threshold_sweep(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Long (group, threshold, metric, estimate) for j_index, sensitivity,
    specificity and distance = (1-sens)^2 + (1-spec)^2."""
    groups = list(groups)
    tc = threshold_counts(pred, groups)
    sens = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    m = tc.select(*groups, "threshold", sens.alias("sensitivity"), spec.alias("specificity"))
    m = m.withColumn("j_index", F.col("sensitivity") + F.col("specificity") - 1) \
        .withColumn("distance", (1 - F.col("sensitivity")) ** 2 + (1 - F.col("specificity")) ** 2)
    names = ["j_index", "sensitivity", "specificity", "distance"]
    return m.unpivot(groups + ["threshold"], names, "metric", "estimate")


def best_threshold(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Arg-max Youden J per group; ties go to the lowest threshold."""
    groups = list(groups)
    sw = threshold_sweep(pred, groups).where(F.col("metric") == "j_index")
    return sw.groupBy(*groups).agg(
        F.max_by("threshold", F.struct(F.col("estimate"), -F.col("threshold"))).alias("threshold"),
        F.max("estimate").alias("j_index"))


def confusion_at(pred: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Dense 2x2 counts at each group's threshold (``>=`` is positive),
    long form with cell labels and the cost reading."""
    groups = list(groups)
    j = null_safe_join(pred, thresholds.select(*groups, "threshold"), groups)
    hat = (F.col(SCORE) >= F.col("threshold")).cast("int")
    cnt = j.groupBy(*groups, "threshold").agg(
        F.sum(((hat == 1) & (F.col(Y) == 1)).cast("long")).alias("TP"),
        F.sum(((hat == 1) & (F.col(Y) == 0)).cast("long")).alias("FP"),
        F.sum(((hat == 0) & (F.col(Y) == 1)).cast("long")).alias("FN"),
        F.sum(((hat == 0) & (F.col(Y) == 0)).cast("long")).alias("TN"))
    long = cnt.unpivot(groups + ["threshold"], ["TP", "FP", "FN", "TN"], "cell", "n")
    # Reading of each cell; a missed positive is the costly error.
    reading = (F.when(F.col("cell") == "TP", "caught")
               .when(F.col("cell") == "FP", "false alarm")
               .when(F.col("cell") == "FN", "missed (costly)")
               .otherwise("correctly cleared"))
    return long.withColumn("predicted", F.when(F.col("cell").isin("TP", "FP"), 1).otherwise(0)) \
        .withColumn("actual", F.when(F.col("cell").isin("TP", "FN"), 1).otherwise(0)) \
        .withColumn("reading", reading)


def metrics_from_counts(df: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity, precision (NULL if undefined, N14), F1."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("TP", "FP", "FN", "TN"))
    prec = F.when(tp + fp > 0, tp / (tp + fp))
    rec = F.when(tp + fn > 0, tp / (tp + fn))
    return df.withColumn("accuracy", (tp + tn) / (tp + fp + fn + tn)) \
        .withColumn("sensitivity", rec) \
        .withColumn("specificity", F.when(tn + fp > 0, tn / (tn + fp))) \
        .withColumn("precision", prec) \
        .withColumn("f_meas", F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)))


METRIC_NAMES = ["accuracy", "sensitivity", "specificity", "precision", "f_meas"]


def class_metrics(pred: DataFrame, groups: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The five class metrics at a fixed cut-off, one aggregate per group."""
    groups = list(groups)
    hat = (F.col(SCORE) >= F.lit(threshold)).cast("int")
    cnt = pred.groupBy(*groups).agg(
        F.sum(((hat == 1) & (F.col(Y) == 1)).cast("long")).alias("TP"),
        F.sum(((hat == 1) & (F.col(Y) == 0)).cast("long")).alias("FP"),
        F.sum(((hat == 0) & (F.col(Y) == 1)).cast("long")).alias("FN"),
        F.sum(((hat == 0) & (F.col(Y) == 0)).cast("long")).alias("TN"))
    return metrics_from_counts(cnt)


def metrics_at(pred: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Long (group, threshold, metric, estimate) at each group's operating
    threshold, plus the threshold-free ROC-AUC."""
    groups = list(groups)
    conf = confusion_at(pred, thresholds, groups)
    wide = conf.groupBy(*groups, "threshold").pivot("cell", ["TP", "FP", "FN", "TN"]).agg(F.first("n"))
    m = null_safe_join(metrics_from_counts(wide), roc_auc(pred, groups), groups)
    return m.unpivot(groups + ["threshold"], METRIC_NAMES + ["roc_auc"], "metric", "estimate")


def fold_metrics(pred: DataFrame, folds_cols: Sequence[str] = ("repeat", "fold"),
                 groups: Sequence[str] = ("model",), threshold: float = 0.5) -> DataFrame:
    """Per (model, repeat, fold) class metrics at 0.5 and ROC-AUC, long form."""
    keys = list(groups) + list(folds_cols)
    cm = null_safe_join(class_metrics(pred, keys, threshold), roc_auc(pred, keys), keys)
    return cm.unpivot(keys, METRIC_NAMES + ["roc_auc"], "metric", "estimate")


def model_compare(fold_long: DataFrame, metric: str = "roc_auc",
                  groups: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and standard error of a metric over resamples, best first.

    Undefined fold values (NULL precision) are skipped by ``avg`` (N14)."""
    f = fold_long.where(F.col("metric") == metric)
    return f.groupBy(*groups).agg(
        F.avg("estimate").alias("mean"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"),
        F.count("estimate").alias("n")).orderBy(F.desc("mean"))


def metrics_wide(fold_long: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of fold metrics, one column per metric (fixed list)."""
    return fold_long.groupBy(*groups).pivot("metric", sorted(METRIC_NAMES + ["roc_auc"])) \
        .agg(F.avg("estimate"))


def best_model(compare: DataFrame) -> DataFrame:
    """Model with the highest mean (ties -> alphabetically first)."""
    return compare.agg(F.min_by("model", F.struct(-F.col("mean"), F.col("model"))).alias("model"),
                       F.max("mean").alias("mean"))


# Display names of the metrics.
FRIENDLY = {"accuracy": "Accuracy", "sensitivity": "Sensitivity (Recall)",
            "specificity": "Specificity", "precision": "Precision", "f_meas": "F1 Score",
            "roc_auc": "ROC AUC", "j_index": "Youden J", "distance": "Distance to corner"}


def display_metrics(long: DataFrame) -> DataFrame:
    """Round to 3 and map metric keys to friendly names."""
    name = None
    for k, v in FRIENDLY.items():
        name = F.when(F.col("metric") == k, v) if name is None else name.when(F.col("metric") == k, v)
    return long.withColumn("metric_name", name.otherwise(F.col("metric"))) \
        .withColumn("estimate", F.round("estimate", 3))


def model_summary(metrics_long: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """One plain-language sentence per model from its test metrics."""
    groups = list(groups)
    w = metrics_long.groupBy(*groups, "threshold").pivot("metric", METRIC_NAMES + ["roc_auc"]) \
        .agg(F.first("estimate"))

    def pct(c):
        return F.coalesce(F.round(F.col(c) * 100.0, 1).cast("string"), F.lit("NA"))
    sentence = F.concat(F.lit("At threshold "), F.col("threshold").cast("string"),
                        F.lit(" the model finds "), pct("sensitivity"),
                        F.lit("% of positives, clears "), pct("specificity"),
                        F.lit("% of negatives; "), pct("precision"),
                        F.lit("% of flagged rows are positive; ROC AUC "),
                        F.coalesce(F.round("roc_auc", 3).cast("string"), F.lit("NA")), F.lit("."))
    return w.select(*groups, "threshold", sentence.alias("summary"))


def roc_with_marker(pred: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """ROC points from the cut-off sweep with (0,0)/(1,1) ends and the
    operating point marked by threshold value (not by position)."""
    groups = list(groups)
    tc = threshold_counts(pred, groups)
    pts = tc.select(*groups, "threshold", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
                    F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))
    models = pred.select(*groups).distinct()
    ends = models.select(*groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"),
                         F.lit(0.0).alias("fpr")).unionByName(
        models.select(*groups, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("tpr"),
                      F.lit(1.0).alias("fpr")))
    best = best_threshold(pred, groups).select(*groups, F.col("threshold").alias("_best"))
    return pts.unionByName(ends).join(best, groups).withColumn(
        "is_operating_point", F.coalesce(F.col("threshold") == F.col("_best"), F.lit(False))).drop("_best")
