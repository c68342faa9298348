"""Exact stratified split and repeated stratified folds.

Order inside each class is the md5 of ``seed:...:id`` (portable to SQL, N20).
Ranks come from ``exact_ranks`` (range-partitioned running counts), so the
majority class - possibly a third of all rows or more - is never sorted in
one task, and the counts are exact: floor(n * num / den) per class to train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_safe_join, seeded_key
from cohortlens.operators.ordering import exact_ranks


def stratified_split(df: DataFrame, id_col: str = "id", outcome: str = "y", seed: int = 42,
                     num: int = 7, den: int = 10) -> DataFrame:
    """L1: adds ``split`` in {'train','test'}; per class floor(n*num/den) rows train."""
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    ranked = exact_ranks(keyed, [outcome], [F.col("_key"), F.col(id_col)], name="_rank")
    sizes = df.groupBy(outcome).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    cut = F.floor(F.col("_n") * num / den)
    return (null_safe_join(ranked, sizes, [outcome])
            .withColumn("split", F.when(F.col("_rank") < cut, "train").otherwise("test"))
            .drop("_key", "_rank", "_n"))


def repeated_folds(df: DataFrame, id_col: str = "id", outcome: str = "y", v: int = 5,
                   repeats: int = 3, seed: int = 42) -> DataFrame:
    """(id, y, repeat, fold): within each (repeat, class) the md5 order is
    dealt round-robin into v folds, so every fold holds n/v +- 1 of each class."""
    rep = df.select(id_col, outcome, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    keyed = rep.withColumn("_key", seeded_key(seed, "repeat", id_col))
    ranked = exact_ranks(keyed, ["repeat", outcome], [F.col("_key"), F.col(id_col)], name="_rank")
    return ranked.select(id_col, outcome, "repeat", ((F.col("_rank") % v) + 1).cast("int").alias("fold"))
