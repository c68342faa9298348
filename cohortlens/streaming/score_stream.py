"""Continuous scoring of profiles that arrive as files.

orders files -> (stream-static joins to customer / nation / region and the
lineitem roll-up) -> clamp cascade (D6) -> score (D2) -> tier (D3) -> risk
factors (D4) -> actions (D5) -> Parquet sink; rows with NULL inputs go to a
reject sink.  The transformation is stateless, so each micro-batch is
independent and the query restarts from its checkpoint after a failure.

Population statistics (subset rates, scorer means/sds, the operating
threshold) are computed once from the static profile and enter the stream as
literals; the per-region medians and bands are a static table joined by key.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from cohortlens.operators import decisions as DS
from cohortlens.operators import evaluate as EV
from cohortlens.plans import order_rules as OR
from cohortlens.session import ensure_checkpoint_dir, materialize
from cohortlens.sources.profile import ORDER_NUMERICS, POSITIVE_PRIORITY, line_summary, profile_table
from cohortlens.sources.tables import read_table


def _literal_stats(profile: DataFrame) -> dict:
    """Everything the stream needs from the population, in ONE aggregate (one row)."""
    conds = OR.rate_conditions()
    aggs = [F.avg(F.when(c, F.col("y").cast("double"))).alias(f"rate_{k}") for k, c in conds.items()]
    aggs += [F.avg(c).alias(f"m_{c}") for c in OR.SCORE_COEF] + \
            [F.stddev_samp(c).alias(f"s_{c}") for c in OR.SCORE_COEF]
    return profile.agg(*aggs).first().asDict()


def stand_in_score(st: dict):
    """The stand-in logistic with literal means and sds."""
    eta = F.lit(OR.SCORE_INTERCEPT)
    for c, b in OR.SCORE_COEF.items():
        # a constant column has no standard deviation: the score is NULL, as in the batch path
        eta = eta + F.lit(b) * F.try_divide(F.col(c) - F.lit(st[f"m_{c}"]).cast("double"), F.lit(st[f"s_{c}"]).cast("double"))
    eta = eta + F.when(F.col("o_orderstatus") == "O", F.lit(OR.SCORE_FLAG_OPEN)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def score_columns(df: DataFrame, st: dict) -> DataFrame:
    """D2-D5 with literal statistics (usable on batch and streaming frames alike)."""
    out = df.withColumn("score", stand_in_score(st))
    out = out.withColumn("tier", DS.risk_tier(F.col("score"), F.lit(st["threshold"])))
    rates = {k: F.lit(st[f"rate_{k}"]) for k in OR.rate_conditions()}
    out = DS.apply_rules(out, OR.rules(), rates)
    return DS.recommend(out, OR.ACTIONS, OR.FALLBACK)


def flatten(df: DataFrame) -> DataFrame:
    """Sink schema: arrays of structs flattened to text for portable files."""
    return df.select(
        "id", "y", F.round("score", 6).alias("score"), "tier",
        F.array_join(F.transform("risk_factors", lambda x: x["key"]), ",").alias("factor_keys"),
        F.array_join(F.transform("actions", lambda x: x["icon"]), ",").alias("action_icons"),
        "n_changed")


def static_sides(spark: SparkSession, sf_dir: str):
    """Literal population statistics (incl. the best-J operating threshold of the
    scorer on the static profile) and the per-region median/band table."""
    prof = profile_table(spark, sf_dir)  # written once an application: every statistic scans it alone
    st = _literal_stats(prof)
    scored = prof.select(F.lit("s").alias("model"), "id", "y", stand_in_score(st).alias("score"))
    st["threshold"] = EV.best_threshold(scored).first()["threshold"]
    med = A.group_median(prof, "r_name", "o_totalprice")
    bands = A.group_bands(prof, "r_name", "o_totalprice")
    return st, med.join(bands, "r_name")


def enrich(orders: DataFrame, spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Orders (batch or stream) -> profile columns via equi-joins to static tables.

    Every order stays: one without a known customer, nation or region has NULLs
    there and is rejected later.  ``lines``: the roll-up of the order lines, if
    it was already made.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    li = lines if lines is not None else line_summary(spark, sf_dir)
    j = (orders.join(c, orders.o_custkey == c.c_custkey, "left")
         .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
         .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderpriority") == POSITIVE_PRIORITY).cast("int").alias("y"),
        "o_orderstatus", "c_mktsegment", "n_name", "r_name", "o_totalprice", "c_acctbal",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("qty_sum", F.lit(0.0)).alias("qty_sum"),
        F.coalesce("disc_avg", F.lit(0.0)).alias("disc_avg"), F.coalesce("tax_avg", F.lit(0.0)).alias("tax_avg"),
        F.coalesce("returned_lines", F.lit(0)).alias("returned_lines"))


def scorable() -> Column:
    """Whether a profile has every input of the score."""
    ok = F.lit(True)
    for name in ["id", "o_totalprice", "c_acctbal", "c_mktsegment", "r_name", *ORDER_NUMERICS]:
        ok = ok & F.col(name).isNotNull()
    return ok


def pipeline_for(df: DataFrame, st: dict, region_side: DataFrame) -> DataFrame:
    from cohortlens.plans.catalog import order_constraints
    j = df.join(region_side, "r_name", "left")
    clamped = DS.clamp_cascade(j, order_constraints())
    return flatten(score_columns(clamped, st))


def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transformation on the static orders table (for equality tests)."""
    st, side = static_sides(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders")
    return pipeline_for(enrich(orders, spark, sf_dir).where(scorable()), st, side)


def stream_score(spark: SparkSession, sf_dir: str, out_dir: str | None = None,
                 source_glob: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Run the stream to completion (availableNow) and return the scored rows.

    Static sides (order-line roll-up, statistics, medians and bands) are written
    once, before the first batch.  One sink splits a batch into ``scored`` and
    ``rejects`` under the batch's id and overwrites on replay, so a restarted
    batch writes nothing twice.  With ``out_dir`` a restart resumes there.
    """
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    st, side = static_sides(spark, sf_dir)
    side = materialize(side, "region_side")
    lines = materialize(line_summary(spark, sf_dir), "lines")
    schema = read_table(spark, sf_dir, "orders").schema
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(source_glob or os.path.join(sf_dir, "orders*.parquet")))

    def sink(batch: DataFrame, epoch: int):
        write_batch(batch, epoch, spark, sf_dir, base, st, side, lines)

    q = (src.writeStream.foreachBatch(sink).trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).start())
    q.awaitTermination()
    return scored_rows(spark, base, pipeline_for(enrich(read_table(spark, sf_dir, "orders"), spark, sf_dir, lines),
                                                 st, side).schema)


def write_batch(batch: DataFrame, epoch: int, spark: SparkSession, sf_dir: str, base: str, st: dict,
                side: DataFrame, lines: DataFrame) -> None:
    """Scored and rejected rows of one batch of orders, each under its batch id."""
    profiles = materialize(enrich(batch, spark, sf_dir, lines), "batch")
    for name, rows in (("scored", pipeline_for(profiles.where(scorable()), st, side)),
                       ("rejects", profiles.where(~scorable()))):
        rows.write.mode("overwrite").parquet(os.path.join(base, name, f"batch={epoch}"))


def scored_rows(spark: SparkSession, base: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(os.path.join(base, "scored", "batch=*"))
