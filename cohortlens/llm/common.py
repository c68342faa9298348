"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir, materialize

__all__ = ["documents", "embeddings", "labels", "materialize", "ensure_checkpoint_dir",
           "ascii_lower", "id_crc", "crc_of_id", "mix64", "ragged", "utf8", "distinct_texts", "IdFilter"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(c: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(c.cast("string").cast("binary"))


def crc_of_id(i: int) -> int:
    return zlib.crc32(str(i).encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c) for every (s, c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def smallest_hashes(hashed: DataFrame, n: int) -> list[int]:
    """The n smallest different values of column h; n bounds what reaches the driver."""
    return [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(n).collect()]


def texts_of(docs: DataFrame, hashes: list[int]) -> list[str]:
    """One text per hash in ``hashes``; copies are combined map-side, no text is shuffled otherwise."""
    rows = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("h").isin(hashes))
    return [r["text"] for r in rows.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()]


class IdFilter:
    """Bitmap over hashes of ids: never misses one of ``ids``, lets few others pass.

    Two bits an id in 16 bits of room for each, at most MAX_BITS (8 MB, the bound
    of what is collected and sent to tasks); beyond about four million ids more
    and more others pass, which costs time and changes no result, as an exact
    join on the ids follows.
    """

    MAX_BITS = 1 << 26

    def __init__(self, ids: DataFrame, column: str):
        self.bits = 1 << 12
        n = ids.count()
        while self.bits < 16 * n and self.bits < self.MAX_BITS:
            self.bits *= 2
        bit = F.explode(F.array(*[F.pmod(h, F.lit(self.bits)) for h in self.hashes(column)]))
        words = (ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).toArrow())
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("x").to_numpy().view(np.uint64)

    @staticmethod
    def hashes(column: str) -> list[Column]:
        return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]

    def passes(self, *hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes[0]), dtype=bool)
        for h in hashes:
            b = (h.view(np.uint64) & np.uint64(self.bits - 1))
            ok &= (self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return ok
