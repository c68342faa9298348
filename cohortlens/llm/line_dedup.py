"""Line dedup over overlapping three-line windows (DataFrame functions only).

Every window of three consecutive lines is hashed (two 64-bit hashes); a window
found more than once keeps its first occurrence, in the order (doc_id, text
hash, line); each later occurrence marks its three lines, overlapping marks
merge, and the marked lines go.  Windows of nothing but white space do not
count.  Repeated windows are found by a grouped minimum (combined map-side) and
an equi-join that adaptive execution may split, so a window shared by a third
of all documents is never gathered in one group; what is collected per document
is bounded by its own lines.

Edge cases: null texts stay null, texts under three lines stay as they are;
rows repeated under one doc_id with one text count as one document; other
columns pass through untouched, ones named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common

SIZE = 3


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_id, _h, covered array<int>): lines of each document inside a later occurrence."""
    lines = F.split(F.col("text"), "\n", -1)
    d = (docs.select("doc_id", "text").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"),
                     lines.alias("lines"))
         .where(F.size("lines") >= SIZE))
    window = F.transform(F.sequence(F.lit(0), F.size("lines") - SIZE), lambda i: F.struct(
        i.alias("pos"), F.concat_ws("\n", F.slice("lines", i + 1, F.lit(SIZE))).alias("w")))
    w = (d.select("_id", "_h", F.explode(window).alias("x"))
         .where(F.col("x.w").rlike(r"\S"))
         .select("_id", "_h", F.col("x.pos").alias("pos"), F.xxhash64("x.w").alias("a"),
                 F.xxhash64(F.lit(1), "x.w").alias("b")))
    at = F.struct("_id", "_h", "pos")
    first = (w.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last"))
             .where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = w.join(first, ["a", "b"]).where(~at.eqNullSafe(F.col("first")))
    return (later.groupBy("_id", "_h").agg(F.collect_set("pos").alias("pos"))
            .select("_id", "_h", F.array_distinct(F.flatten(F.transform("pos", lambda p: F.array(
                *[p + i for i in range(SIZE)])))).alias("covered")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``text`` rid of later occurrences, plus n_lines, n_removed."""
    lines = F.split(F.col("__row.text"), "\n", -1)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.xxhash64("text").alias("_h"))
    joined = rows.alias("d").join(
        repeated_windows(docs).alias("m"), F.col("__row.doc_id").eqNullSafe(F.col("m._id"))
        & (F.col("d._h") == F.col("m._h")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("m.covered"))
    text = F.when(F.col("m.covered").isNull(), F.col("__row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    same = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    n_lines = F.when(F.col("__row.text").isNull(), 0).otherwise(F.size(lines))
    n_removed = F.when(F.col("m.covered").isNull(), 0).otherwise(F.size("m.covered"))
    out = joined.select("__row", text.alias("__text"), n_lines.cast("long").alias("__lines"),
                        n_removed.cast("long").alias("__removed"))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in same], F.col("__text").alias("text"),
                      F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i AS pos, lines[i] || chr(10) || lines[i+1] || chr(10) || lines[i+2] AS win
  FROM l, range(1, greatest(len(lines) - 1, 1)) AS r(i)),
k AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth
  FROM w WHERE regexp_matches(win, '\S')),
c AS (
  SELECT DISTINCT doc_id, pos + j AS line FROM k, range(0, 3) AS s(j) WHERE nth > 1),
x AS (
  SELECT l.doc_id, i AS line, lines[i] AS content FROM l, range(1, len(lines) + 1) AS r(i)),
y AS (
  SELECT x.doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
         string_agg(CASE WHEN c.line IS NULL THEN content END, chr(10) ORDER BY x.line) AS text
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.line = c.line GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(y.n_lines, 0) AS n_lines, coalesce(y.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(y.text, '') END AS text
FROM documents d LEFT JOIN y ON d.doc_id = y.doc_id
"""
