"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; projections/filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             null_value: str = "NA") -> DataFrame:
    """CSV with header. An explicit schema is the norm; inference is the fallback."""
    r = spark.read.option("header", True).option("nullValue", null_value)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Overwrite-mode sink; CSV gets a header, NULL as NA and no row index."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("nullValue", "NA").csv(path)
    else:
        w.format(fmt).save(path)


def read_metric_table(spark: SparkSession, path: str, fmt: str = "parquet",
                      name_col: str = "model") -> DataFrame:
    """S3: re-read a published metric table and prettify the model names."""
    df = spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").format(fmt).load(path)
    if name_col in df.columns:
        df = df.withColumn(name_col, F.regexp_replace(name_col, "_", " "))
    return df


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column with its type and kind, plus the row count.

    Column metadata comes from the schema (driver-side, no data); the row
    count is a scalar subquery, so nothing but the count is scanned.
    """
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), column_kind(f.dataType.simpleString()))
            for i, f in enumerate(df.schema.fields)]
    meta = spark.createDataFrame(rows, "position int, column_name string, data_type string, kind string")
    return meta.withColumn("n_rows", df.select(F.count(F.lit(1))).scalar())


def column_kind(type_name: str) -> str:
    if type_name in ("string", "boolean"):
        return "categorical"
    if type_name in ("tinyint", "smallint", "int", "bigint", "float", "double") or type_name.startswith("decimal"):
        return "numeric"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Select-by-type predicate, evaluated on the schema only."""
    return [f.name for f in df.schema.fields if column_kind(f.dataType.simpleString()) == kind]
