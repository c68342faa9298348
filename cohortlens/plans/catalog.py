"""Bindings of the operators to the driver's tables: query key -> (spark, sf_dir) -> DataFrame.

Every binding reads whole tables (or frames Spark derives from them); every
double is rounded (6 decimals unless stated) and -0.0 folded, so results hash
the same as the SQL oracle in ``oracle.py``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import friendly_name, percent_label, thousands
from cohortlens.operators import aggregates as A
from cohortlens.operators import quality as Q
from cohortlens.operators import stats as S
from cohortlens.operators import splits as SP
from cohortlens.operators import evaluate as EV
from cohortlens.operators import features as FE
from cohortlens.operators import smote as SM
from cohortlens.operators import models as MD
from cohortlens.operators import tuning as TU
from cohortlens.operators.ledger import Ledger, fit_plan, units
from cohortlens.operators import decisions as DS
from cohortlens.plans import order_rules as OR
from cohortlens.streaming import score_stream as ST
from cohortlens.session import ensure_checkpoint_dir, materialize
from cohortlens.sources.profile import (ORDER_CATEGORICALS, ORDER_NUMERICS, profile_table,
                                       scores_table)
from cohortlens.sources.tables import (columns_of_kind, read_csv, read_metric_table, read_table, schema_report,
                                       write_table)

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and fold -0.0 into 0.0."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out.append((F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def _profile(spark, sf):
    return profile_table(spark, sf)


# ---------------------------------------------------------------- quality
def q_null_report(spark, sf):
    return Q.null_report(_profile(spark, sf))


def q_duplicate_rows(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return Q.duplicate_rows(li, key=["l_orderkey", "l_linenumber"])


def q_key_uniqueness(spark, sf):
    parts = [Q.key_uniqueness(read_table(spark, sf, "orders"), ["o_orderkey"], "orders"),
             Q.key_uniqueness(read_table(spark, sf, "customer"), ["c_custkey"], "customer"),
             Q.key_uniqueness(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                              "lineitem")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_schema_report(spark, sf):
    """Column names, types and kinds of the orders table plus its row count."""
    return schema_report(read_table(spark, sf, "orders"))


def q_cardinality(spark, sf):
    return Q.cardinality(_profile(spark, sf))


def q_constant_columns(spark, sf):
    return Q.constant_columns(read_table(spark, sf, "lineitem"))


def q_constant_columns_urgent(spark, sf):
    """Q9 where there is something to find: the profile's rows of the positive outcome."""
    return Q.constant_columns(_profile(spark, sf).where("y = 1"))


def q_modelling_columns(spark, sf):
    """The profile without its identifier, numeric columns only."""
    kept = Q.drop_columns(_profile(spark, sf), ["id"])
    return finalize(kept.select(*columns_of_kind(kept, "numeric")))


def _published(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_orders_csv(spark, sf):
    """The orders table written as CSV and scanned again with its schema."""
    orders = read_table(spark, sf, "orders")
    path = _published(spark, "orders_csv")
    write_table(orders, path, fmt="csv")
    return finalize(read_csv(spark, path, orders.schema))


def q_metric_reread(spark, sf):
    """S3: the ranking by point-biserial r, published as CSV, re-read with readable names."""
    path = _published(spark, "pb_ranking")
    write_table(q_pb_ranking(spark, sf), path, fmt="csv")
    return read_metric_table(spark, path, fmt="csv", name_col="variable")


def q_freq_tables(spark, sf):
    return finalize(Q.freq_table(_profile(spark, sf), ORDER_CATEGORICALS))


def q_numeric_summary(spark, sf):
    return finalize(Q.numeric_summary(_profile(spark, sf), ORDER_NUMERICS))


def q_iqr_outliers(spark, sf):
    return finalize(Q.iqr_outliers(read_table(spark, sf, "lineitem"), LINE_MEASURES))


def q_box_stats(spark, sf):
    return finalize(Q.box_stats(read_table(spark, sf, "lineitem"), LINE_MEASURES))


# Domain rules of the order profile: (rule, column, lo, hi).
ORDER_RULES = [
    ("lines_per_order", "n_lines", 1, 7),
    ("discount_range", "disc_avg", 0.0, 0.10),
    ("tax_range", "tax_avg", 0.0, 0.08),
    ("quantity_range", "qty_sum", 1, 350),
    ("balance_range", "c_acctbal", -999.99, 9999.99),
    ("returned_within_lines", "returned_lines", 0, 7),
]


def q_range_violations(spark, sf):
    return finalize(Q.range_violations(_profile(spark, sf), ORDER_RULES))


def q_noise_screen(spark, sf):
    return finalize(Q.noise_screen(_profile(spark, sf), ["c_acctbal", "disc_avg", "tax_avg"],
                                   "o_totalprice"))


# ------------------------------------------------------------- aggregates
OUTCOME_MEANS = {
    "avg_totalprice": ("o_totalprice", 2),
    "avg_acctbal": ("c_acctbal", 2),
    "avg_lines": ("n_lines", 2),
    "avg_qty": ("qty_sum", 2),
    "avg_discount": ("disc_avg", 4),
    "avg_tax": ("tax_avg", 4),
    "avg_returned": ("returned_lines", 2),
}


def q_outcome_profile(spark, sf):
    df = _profile(spark, sf)
    return finalize(A.outcome_profile(df, OUTCOME_MEANS,
                                      {"pct_open": F.col("o_orderstatus") == "O"}))


def q_rate_by_category(spark, sf):
    return finalize(A.rate_by_category(_profile(spark, sf), ORDER_CATEGORICALS))


def q_rate_with_reference(spark, sf):
    return finalize(A.rate_with_reference(_profile(spark, sf), ORDER_CATEGORICALS))


def q_category_share(spark, sf):
    return finalize(A.category_share(_profile(spark, sf), ORDER_CATEGORICALS))


def q_likert_share(spark, sf):
    return finalize(A.likert_share(_profile(spark, sf), ["n_lines", "returned_lines"]))


def q_grand_share(spark, sf):
    return finalize(A.grand_share(_profile(spark, sf), "y"))


def q_event_share(spark, sf):
    ev = read_table(spark, sf, "events").select(
        "event_type", F.dayofweek("ts").alias("weekday"))
    counts = ev.groupBy("weekday", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return finalize(Q.with_share(counts, ["weekday"], "n", "share"))


def q_contingency_dense(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return A.dense_contingency(li, "l_returnflag", "l_linestatus")


# Population rules whose subset rates feed the risk-factor details.
def order_rule_predicates():
    return {
        "status_open": F.col("o_orderstatus") == "O",
        "segment_building": F.col("c_mktsegment") == "BUILDING",
        "few_lines": F.col("n_lines") <= 2,
        "no_discount": F.col("disc_avg") <= 0.02,
        "any_returned": F.col("returned_lines") >= 1,
        "negative_balance": F.col("c_acctbal") < 0,
    }


def q_population_rates(spark, sf):
    return finalize(A.conditional_rates(_profile(spark, sf), order_rule_predicates()))


PRICE_BREAKS = [0, 50000, 100000, 200000, 300000, 400000]
PRICE_LABELS = ["<=50K", "50-100K", "100-200K", "200-300K", "300-400K"]
BALANCE_BREAKS = [-1000, 0, 2500, 5000, 10000]
BALANCE_LABELS = ["negative", "0-2.5K", "2.5-5K", "5-10K"]


def q_binned_rate(spark, sf):
    return finalize(A.binned_rate(_profile(spark, sf), {
        "o_totalprice": (PRICE_BREAKS, PRICE_LABELS),
        "c_acctbal": (BALANCE_BREAKS, BALANCE_LABELS)}))


def q_tenure_curve(spark, sf):
    return finalize(A.tenure_curve(_profile(spark, sf), "n_lines"))


COHORT = {"equals": {"o_orderstatus": "All", "c_mktsegment": "BUILDING", "r_name": "All"},
          "ranges": {"o_totalprice": (50000.0, 300000.0)}}


def q_cohort_kpis(spark, sf):
    df = _profile(spark, sf)
    cohort = A.cohort_filter(df, COHORT["equals"], COHORT["ranges"])
    return finalize(A.cohort_kpis(cohort, {"avg_totalprice": "o_totalprice",
                                           "avg_acctbal": "c_acctbal"}))


def q_cohort_summary(spark, sf):
    df = _profile(spark, sf)
    cohort = A.cohort_filter(df, COHORT["equals"], COHORT["ranges"])
    return finalize(A.cohort_summary(df, cohort))


def q_group_median_flag(spark, sf):
    return finalize(A.group_median_flag(read_table(spark, sf, "part"), "p_type", "p_retailprice"))


def q_group_bands(spark, sf):
    return A.group_bands(read_table(spark, sf, "part"), "p_type", "p_retailprice")


def q_values_per_group(spark, sf):
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    return A.values_per_group(n.join(r, n.n_regionkey == r.r_regionkey), "r_name", "n_name")


def q_group_value_rows(spark, sf):
    """The part types of every brand, a row each."""
    return A.group_value_rows(read_table(spark, sf, "part"), "p_brand", "p_type")


# ------------------------------------------------------------- statistics
def q_pearson_long(spark, sf):
    return finalize(S.pearson_long(_profile(spark, sf), ORDER_NUMERICS))


def q_strong_pairs(spark, sf):
    return finalize(S.strong_pairs(_profile(spark, sf), ORDER_NUMERICS))


def q_pb_ranking(spark, sf):
    return finalize(S.point_biserial(_profile(spark, sf), ORDER_NUMERICS))


def q_chi_square(spark, sf):
    return finalize(S.chi_square(_profile(spark, sf), ORDER_CATEGORICALS), 4)


def q_mc_pvalue(spark, sf):
    return S.mc_pvalue(_profile(spark, sf), ORDER_CATEGORICALS, b=2000)


def q_chi_square_asymptotic(spark, sf):
    return finalize(S.chi_square_asymptotic(_profile(spark, sf), ORDER_CATEGORICALS))


def q_mc_statistic(spark, sf):
    """The observed statistic that the Monte-Carlo test compares its draws with."""
    return finalize(S.mc_pvalue(_profile(spark, sf), ORDER_CATEGORICALS, b=200).select("variable", "chi_sq"), 4)


def q_histogram(spark, sf):
    return finalize(S.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice", 30), 4)


def q_histogram_by_outcome(spark, sf):
    return finalize(S.histogram(_profile(spark, sf), "o_totalprice", 30, by="y"), 4)


def q_scatter_bins(spark, sf):
    return S.scatter_bins(_profile(spark, sf), "o_totalprice", "qty_sum", "y", 20)


def q_kde(spark, sf):
    kd = S.kde(read_table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", 64)
    return kd.select("c_mktsegment", "point", F.round("x", 4).alias("x"),
                     F.round(F.col("density") * 1e6, 6).alias("density_e6"))


# ------------------------------------------------------- splits and folds
def _orders_y(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


def q_stratified_split(spark, sf):
    return SP.stratified_split(_orders_y(spark, sf), seed=42)


def q_folds(spark, sf):
    train = SP.stratified_split(_orders_y(spark, sf), seed=42).where(F.col("split") == "train")
    return SP.repeated_folds(train.select("id", "y"), v=5, repeats=3, seed=42)


# ------------------------------------------------------------- evaluation
def _doc_folds(spark, sf):
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    return SP.repeated_folds(lab, v=5, repeats=3, seed=7)


def _scores(spark, sf):
    return scores_table(spark, sf)


def q_roc_curve(spark, sf):
    return finalize(EV.roc_curve(_scores(spark, sf)))


def q_pr_curve(spark, sf):
    return finalize(EV.pr_curve(_scores(spark, sf)))


def q_pr_baseline(spark, sf):
    return finalize(EV.pr_baseline(_scores(spark, sf)))


def q_auc(spark, sf):
    return finalize(EV.roc_auc(_scores(spark, sf)))


def q_threshold_sweep(spark, sf):
    return finalize(EV.threshold_sweep(_scores(spark, sf)))


def q_best_threshold(spark, sf):
    return finalize(EV.best_threshold(_scores(spark, sf)))


def q_confusion(spark, sf):
    pred = _scores(spark, sf)
    return finalize(EV.confusion_at(pred, EV.best_threshold(pred)))


def q_metrics_at(spark, sf):
    pred = _scores(spark, sf)
    return finalize(EV.metrics_at(pred, EV.best_threshold(pred)))


def _fold_long(spark, sf):
    pred = _scores(spark, sf).join(_doc_folds(spark, sf).drop("y"), "id")
    return EV.fold_metrics(pred)


def q_fold_metrics(spark, sf):
    return finalize(_fold_long(spark, sf))


def q_model_compare(spark, sf):
    return finalize(EV.model_compare(_fold_long(spark, sf)))


def q_metrics_wide(spark, sf):
    return finalize(EV.metrics_wide(_fold_long(spark, sf)))


def q_metric_mean_se(spark, sf):
    """Every metric's mean and standard error over the held-out folds."""
    return finalize(A.mean_se(_fold_long(spark, sf), ["model", "metric"], "estimate"))


def q_rate_pivot(spark, sf):
    """Outcome rate per region, order statuses as columns."""
    return finalize(A.mean_pivot(_profile(spark, sf), "r_name", "o_orderstatus", "y", ["F", "O", "P"]))


def q_display_formats(spark, sf):
    """Labels of a per-nation table (share in debt, balance, readable name)."""
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    per = c.groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") < 0).cast("double")).alias("share"),
                                       F.sum("c_acctbal").alias("balance"))
    return per.join(n, per.c_nationkey == n.n_nationkey).select(
        friendly_name("n_name").alias("nation"), percent_label("share").alias("in_debt"),
        thousands("balance").alias("balance"))


def q_best_model(spark, sf):
    return finalize(EV.best_model(EV.model_compare(_fold_long(spark, sf))))


def q_display_metrics(spark, sf):
    pred = _scores(spark, sf)
    return finalize(EV.display_metrics(EV.metrics_at(pred, EV.best_threshold(pred))))


def q_model_summary(spark, sf):
    pred = _scores(spark, sf)
    return EV.model_summary(EV.metrics_at(pred, EV.best_threshold(pred)))


def q_roc_marker(spark, sf):
    return finalize(EV.roc_with_marker(_scores(spark, sf)))


# --------------------------------------------------------------- features
def q_engineered_features(spark, sf):
    df = FE.engineered_features(_profile(spark, sf), FE.ORDER_FEATURES)
    return finalize(df.select("id", *FE.ORDER_FEATURES))


NZV_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def q_nzv_report(spark, sf):
    return finalize(FE.nzv_report(read_table(spark, sf, "lineitem"), NZV_COLS))


DUMMY_COLS = ["o_orderstatus", "c_mktsegment", "r_name"]


def q_dummy_coding(spark, sf):
    df = _profile(spark, sf)
    levels = FE.categorical_levels(df, DUMMY_COLS)
    return FE.dummy_columns(df.select("id", *DUMMY_COLS), levels)


def q_normalize(spark, sf):
    df = _profile(spark, sf)
    return finalize(FE.standardize(df.select("id", *ORDER_NUMERICS), ORDER_NUMERICS))


#: Components of an embedding in the test table.
EMBEDDING_DIM = 64


def _embeddings_binary(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))


def q_smote_neighbours(spark, sf):
    e = _embeddings_binary(spark, sf).where("y = 1")
    return finalize(SM.knn_within(e, "vec_id", "embedding", k=5)
                    .withColumnRenamed("id", "vec_id"))


def q_smote_rows(spark, sf):
    """The synthetic rows as a wide training frame, one column per component."""
    new = SM.smote(_embeddings_binary(spark, sf), "vec_id", "embedding", "y", minority=1,
                   over_ratio=0.8, k=5, seed=42)
    return finalize(new.select("synthetic_id", "parent_id", "nn_id", "gap", "y",
                               *[F.get("embedding", F.lit(i)).alias(f"x{i + 1}") for i in range(EMBEDDING_DIM)]))


# ------------------------------------------------------ models and tuning
_ML_RUNS: dict = {}


def ml_run(spark, sf):
    """Tune ``query_specs`` (the whole plan, 930 fits) on the order profile's training split (5
    folds x 3 repeats), refit the best model on all training rows and score the
    test rows; the threshold comes from the winner's pooled held-out predictions.
    Memoised per (application, sf_dir) so the model queries share one run."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _ML_RUNS:
        return _ML_RUNS[key]
    prof = _profile(spark, sf)
    split = SP.stratified_split(prof.select("id", "y"), seed=42)
    feats = prof.drop("y")
    both = materialize(feats.join(split.select("id", "y", "split"), "id"), "profile-split")
    train = both.where("split = 'train'").drop("split")
    test = both.where("split = 'test'").drop("split")
    folds = materialize(SP.repeated_folds(train.select("id", "y"), v=5, repeats=3, seed=42), "folds")
    specs = MD.query_specs()
    rc = TU.Recipe(ORDER_NUMERICS, ORDER_CATEGORICALS, FE.ORDER_FEATURES,
                   levels=FE.categorical_levels(both, ORDER_CATEGORICALS))
    path = TU.tune(spark, specs, train, folds, rc, parallelism=8)
    pred = TU.read_predictions(spark, path)
    cv = materialize(TU.cv_metrics(pred), "cv-metrics")  # a few rows a fit, read by every table of the run
    best = materialize(TU.select_best(cv), "cv-best")
    best_rows = best.collect()  # one row per model family
    first = EV.best_model(best).first()["model"]
    winner = next(r for r in best_rows if r["model"] == first)
    spec = next(sp for sp in specs if sp.name == first)
    final = TU.fit_one(spec, spec.grid[int(winner["config"])], train, rc)
    test_pred = TU.score(final, test).select(F.lit(spec.name).alias("model"), "id", "y", "score")
    pooled = TU.best_only(pred, best).where(F.col("model") == first)
    thr = materialize(EV.best_threshold(pooled), "threshold")
    bundle = os.path.join(ensure_checkpoint_dir(spark), f"bundle-{uuid.uuid4().hex}")
    TU.save_bundle(final, thr.first()["threshold"], bundle)
    prepped = final.stages[0].transform(train)
    ledger = Ledger(spark, path).table(units(specs, TU.resamples_of(folds)))
    run = {"specs": specs, "pred_path": path, "ledger": ledger, "cv": cv, "best": best, "best_rows": best_rows,
           "winner": winner["model"], "final": final, "test_pred": test_pred, "thr": thr,
           "bundle": bundle, "prepped": prepped}
    _ML_RUNS[key] = run
    return run


def q_fit_plan(spark, sf):
    """All 930 fits of the full plan with the rows each one reads."""
    return fit_plan(spark, MD.reference_specs(), q_folds(spark, sf))


#: Configs of a family that the SQL of fit_ledger lists; the run fits them all.
LISTED_CONFIGS = {"random_forest": 2, "gradient_boosting": 2}


def q_fit_ledger(spark, sf):
    """Fits of the registered tuning run with their states, read from the run's ledger: those that the query's SQL lists."""
    listed = F.lit(True)
    for model, n in LISTED_CONFIGS.items():
        listed = listed & ((F.col("model") != model) | (F.col("config") < n))
    return ml_run(spark, sf)["ledger"].where(listed).select("model", "config", "repeat", "fold", "state")


def q_model_cv(spark, sf):
    return finalize(ml_run(spark, sf)["cv"])


def q_model_select(spark, sf):
    run = ml_run(spark, sf)
    return finalize(EV.model_compare(TU.best_only(run["cv"], run["best"])))


def q_model_metrics_wide(spark, sf):
    run = ml_run(spark, sf)
    return finalize(EV.metrics_wide(TU.best_only(run["cv"], run["best"])))


def q_best_params(spark, sf):
    run = ml_run(spark, sf)
    return TU.best_params_long(spark, run["specs"], run["best_rows"])


def q_importance(spark, sf):
    run = ml_run(spark, sf)
    return TU.importance(run["final"], run["prepped"]).withColumn("model", F.lit(run["winner"]))


def _pooled_best(spark, sf):
    """Held-out predictions of each model's best config, pooled over resamples."""
    run = ml_run(spark, sf)
    pred = TU.read_predictions(spark, run["pred_path"])
    return TU.best_only(pred, run["best"])


def q_cv_roc_curve(spark, sf):
    return finalize(EV.roc_curve(_pooled_best(spark, sf)))


def q_cv_pr_curve(spark, sf):
    return finalize(EV.pr_curve(_pooled_best(spark, sf)))


def q_final_metrics(spark, sf):
    run = ml_run(spark, sf)
    return finalize(EV.metrics_at(run["test_pred"], run["thr"]))


def q_final_threshold_curve(spark, sf):
    run = ml_run(spark, sf)
    return finalize(EV.threshold_sweep(run["test_pred"]))


def q_model_score(spark, sf):
    """D2 with the persisted bundle: load it and score the whole profile table."""
    run = ml_run(spark, sf)
    model, t = TU.load_bundle(spark, run["bundle"])
    scored = TU.score(model, _profile(spark, sf))
    return finalize(scored.select("id", "y", "score", (F.col("score") >= t).cast("int").alias("predicted")))


# -------------------------------------------------------- decision support
def scored_profile(spark, sf):
    """The stand-in fixed-coefficient scorer over the whole profile."""
    df = _profile(spark, sf)
    sc = DS.logistic_score(df, OR.SCORE_COEF, OR.SCORE_INTERCEPT,
                           {"open": (F.col("o_orderstatus") == "O", OR.SCORE_FLAG_OPEN)})
    return df.withColumn("score", sc)


def q_score_batch(spark, sf):
    return finalize(scored_profile(spark, sf).select("id", "y", "score"))


def _tiered(spark, sf):
    sc = scored_profile(spark, sf)
    thr = EV.best_threshold(sc.select(F.lit("stand_in").alias("model"), "id", "y", "score"))
    return sc.withColumn("threshold", thr.select("threshold").scalar()) \
        .withColumn("tier", DS.risk_tier(F.col("score"), F.col("threshold")))


def q_risk_tiers(spark, sf):
    return finalize(_tiered(spark, sf).select("id", "score", "threshold", "tier"))


def q_tier_summary(spark, sf):
    t = _tiered(spark, sf)
    return finalize(t.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"),
                                          F.avg("score").alias("mean_score")))


def _explained(spark, sf):
    df = _profile(spark, sf)
    stats = DS.population_stats(df, OR.rate_conditions())
    med = A.group_median(df, "r_name", "o_totalprice")
    out = DS.apply_rules(df.join(med, "r_name"), OR.rules(), stats)
    return DS.recommend(out, OR.ACTIONS, OR.FALLBACK)


def q_risk_factors(spark, sf):
    ex = _explained(spark, sf)
    return ex.select(
        "id", F.size("risk_factors").alias("n_factors"),
        F.array_join(F.transform("risk_factors", lambda x: x["key"]), ",").alias("factor_keys"),
        F.size(F.filter("risk_factors", lambda x: x["severity"] == "high")).alias("n_high"),
        F.array_join(F.transform("risk_factors", lambda x: F.concat_ws(": ", x["label"], x["detail"])), " | ")
        .alias("details"))


def q_recommendations(spark, sf):
    ex = _explained(spark, sf)
    return ex.select("id", F.size("actions").alias("n_actions"),
                     F.array_join(F.transform("actions", lambda x: x["icon"]), ",").alias("action_icons"))


def order_constraints():
    c, L = F.col, F.lit
    return [
        ("n_lines", lambda: L(0), lambda: L(7)),
        ("returned_lines", lambda: L(0), lambda: c("n_lines")),
        ("qty_sum", lambda: L(0.0), lambda: c("n_lines") * 50.0),
        ("o_totalprice", lambda: c("band_lo").cast("double"), lambda: c("band_hi").cast("double")),
    ]


def q_clamp_profile(spark, sf):
    df = _profile(spark, sf)
    bands = A.group_bands(df, "r_name", "o_totalprice")
    out = DS.clamp_cascade(df.join(bands, "r_name"), order_constraints())
    return finalize(out.select("id", "n_lines", "returned_lines", "qty_sum", "o_totalprice", "n_changed"))


def q_valid_pairs(spark, sf):
    """Customer region x supplier nation of every line, valid when the
    supplier's nation lies in the customer's region (``valid_choice``)."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    cust_region = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), "r_name")
    supp_nation = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    lines = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey).join(cust_region, "c_nationkey")
             .join(supp_nation, "s_nationkey")
             .groupBy("r_name", "supplier_nation").agg(F.count(F.lit(1)).alias("n_lines")))
    pairs = n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", F.col("n_name").alias("supplier_nation"))
    # the operator replaces invalid choices; the key reports each pair as it was met
    checked = DS.valid_choice(lines.withColumn("choice", F.col("supplier_nation")),
                              pairs.withColumnRenamed("supplier_nation", "choice"), "r_name", "choice")
    return checked.select("r_name", "supplier_nation", "n_lines", F.col("choice_was_valid").alias("is_valid"))


# --------------------------------------------------------------- streaming
def q_stream_score(spark, sf):
    """Orders as a file stream (availableNow) scored and explained."""
    return ST.stream_score(spark, sf)


def query_catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}
