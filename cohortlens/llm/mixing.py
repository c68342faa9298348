"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's mean repetition rate is ``weight * total / rows of the source``, with
weights scaled to one; without given weights they are proportional to
``rows ** alpha`` (temperature).  Each document draws its count by inverting the
Poisson distribution of its source's rate at a uniform seeded by a hash of
(seed, doc_id), is exploded by that count, and the copies are sorted globally by
a hash of (seed, doc_id, copy), ties by a hash of the text.  A row without an id
is known by an md5 of its text and source instead, in both hashes, so such rows
draw apart and spread over the order.  The distribution function is a table from
12 standard deviations and 20 below the rate to as much above, built from the
mode outwards and scaled to one, so no rate underflows.  Counts per source are combined map-side; the
small table of distribution functions joins on the source; it is broadcast when
it counts at most BROADCAST_SOURCES rows, otherwise a split equi-join moves the
documents to it.

Edge cases: null sources form a source of their own; rows of one id share one
draw, as do rows without an id that are equal in text and source; a rate of 0
drops a source; extra columns pass through, ones named copies, copy or
shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common


#: Up to so many sources their table (some 300 bytes a row) is sent to all tasks; the result is the same.
BROADCAST_SOURCES = 20_000


def _uniform(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of an md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def _identity(row: str, columns: list[str]) -> Column:
    """What a row is hashed by: its doc_id, or an md5 of text and source where that is null."""
    content = F.concat(*[F.when(F.col(f"{row}.{c}").isNull(), "-").otherwise(F.concat(F.lit("+"), F.md5(F.col(f"{row}.{c}"))))
                         for c in ("text", "source") if c in columns])
    return F.coalesce(F.col(f"{row}.doc_id").cast("string"), F.concat(F.lit(":"), content))


def rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5) -> DataFrame:
    """(source, rate, first, cdf): mean repetitions and Poisson distribution function from ``first`` on per source."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights:
        table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
        n = n.withColumn("w", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)).cast("double"))
    else:
        n = n.withColumn("w", F.pow("n", F.lit(alpha)))
    whole = n.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()  # one row
    scale = whole["all_n"] / whole["all_w"] if whole["all_w"] else 0.0
    rate = F.col("w") * F.lit(float(scale)) / F.col("n")
    reach = 12 * F.sqrt("rate") + 20
    mode = F.floor("rate")
    first, last = F.greatest(F.lit(0).cast("long"), F.floor(F.col("rate") - reach)), F.ceil(F.col("rate") + reach)

    def weights_from_mode(steps: Column, factor) -> Column:
        """Poisson weights in units of the mode's, the mode first."""
        one = F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("out"))

        def step(acc, i):
            p = acc["p"] * factor(i)
            return F.struct(p.alias("p"), F.concat(acc["out"], F.array(p)).alias("out"))

        numbers = F.slice(F.sequence(F.lit(0).cast("long"), steps), 2, (steps + 1).cast("int"))  # 1 to steps
        return F.aggregate(numbers, one, step, lambda acc: acc["out"])

    def add(acc, p):
        c = acc["c"] + p
        return F.struct(c.alias("c"), F.concat(acc["out"], F.array(c)).alias("out"))

    down = weights_from_mode(F.col("mode") - F.col("first"), lambda i: (F.col("mode") - i + 1) / F.col("rate"))
    up = weights_from_mode(F.col("last") - F.col("mode"), lambda i: F.col("rate") / (F.col("mode") + i))
    p = F.concat(F.reverse(down), F.slice(up, 2, F.size(up)))
    none = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("out"))
    cdf = F.aggregate(p, none, add, lambda acc: F.transform(acc["out"], lambda c: c / acc["c"]))
    n = n.select("source", rate.alias("rate")).select(
        "source", "rate", first.alias("first"), mode.alias("mode"), last.alias("last"))
    return n.select("source", "rate", "first", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, seed: int = 7) -> DataFrame:
    """Rows of ``docs`` repeated by their draws, plus copies, copy (from 1) and shuffle_key; shuffled."""
    r = rates(docs, weights, alpha)
    if r.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    drawn = docs.select(row).withColumn("__u", _uniform(seed, _identity("__row", docs.columns))).alias("d").join(
        r.alias("r"), F.col("__row.source").eqNullSafe(F.col("r.source")))
    drawn = drawn.select("__row", (F.col("r.first") + F.size(F.filter(F.col("r.cdf"), lambda x: x <= F.col("__u")))).cast("int").alias("__n"))
    drawn = drawn.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    drawn = drawn.withColumn("__key", _uniform(seed + 1, _identity("__row", docs.columns), F.col("__copy")))
    drawn = drawn.orderBy("__key", *([F.xxhash64(F.col("__row.text"))] if "text" in docs.columns else []))
    same = [c for c in docs.columns if c not in ("copies", "copy", "shuffle_key")]
    return drawn.select(*[F.col("__row").getField(c).alias(c) for c in same], F.col("__n").alias("copies"),
                        F.col("__copy").alias("copy"), F.col("__key").alias("shuffle_key"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "copies", "shuffle_key", "text")


def mix_sql(docs: str, columns: str, alpha: float = 0.5, seed: int = 7) -> str:
    """DuckDB SQL of :func:`mix` over a relation; the distribution functions are summed term by term, in logarithms."""
    u = "(('0x' || substr(md5('{s}:' || {k}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"
    known = ("coalesce(doc_id::VARCHAR, ':' || coalesce('+' || md5(text), '-') || coalesce('+' || md5(source), '-'))")
    return f"""
WITH r AS (
  SELECT source, w * sum(n) OVER () / (sum(w) OVER () * n) AS rate
  FROM (SELECT source, count(*) AS n, pow(count(*), {alpha}) AS w FROM {docs} GROUP BY source)),
p AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r)),
c AS (
  SELECT source, list(c) AS cdf
  FROM (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p) GROUP BY source),
d AS (
  SELECT d.*, {known} AS known FROM {docs} d)
SELECT {columns}, copy::INTEGER AS copy, copies::INTEGER AS copies,
       {u.format(s=seed + 1, k="known || ':' || copy::VARCHAR")} AS shuffle_key
FROM (
  SELECT d.*, len(list_filter(c.cdf, lambda x: x <= {u.format(s=seed, k="d.known")})) AS copies
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source), range(1, copies + 1) AS e(copy)
"""


OP9_SQL = mix_sql("documents", "doc_id, source, text")
