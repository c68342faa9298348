"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum (combined map-side) and an equi-join back, so a
node with very many links is never gathered; each round is written to the shared
folder.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b) -> links to the smallest neighbour."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(low, "a")
    if large:  # neighbours above the node move to its smallest neighbour
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node and its neighbours below move to the smallest of them
        out = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select("a", F.col("m").alias("b"))))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node of ``links`` (a, b) but the smallest ones."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = common.materialize(links.select(high.alias("a"), low.alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        e = common.materialize(_star(_star(e, True), False), "links")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == (now["n"], now["s"]):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (now["n"], now["s"])
