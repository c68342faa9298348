"""Clean vector tables, shared by the two searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id, v array<double>) of usable rows.

    Null vectors and ids, vectors holding null or non-finite components and,
    with ``nonzero``, zero vectors take no part; neither do vectors whose length
    is not the table's most frequent one (ties: the longer).
    """
    v = F.col(vec).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    size = (out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    out = out.where((F.size("v") == (size[0]["d"] if size else 0))).where(
        F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return out.where(F.exists("v", lambda x: x != 0)) if nonzero else out
