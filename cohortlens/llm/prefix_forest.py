"""Approximate nearest neighbours with a forest of sorted hash strings.

Each tree hashes a vector to a 64-bit string of random-hyperplane signs; for
inner products a vector gets one more component that makes all norms equal, the
query a zero (so the nearest by angle is the nearest by product).  A tree is the
array of all strings in order, range-partitioned by (tree, string).  A query
finds its place in the array and descends to the longest prefix that any string
shares with it; if fewer than ``quota`` strings share that prefix the prefix is
shortened bit by bit, for all queries and trees at the same pace, until enough
do.  All vectors under the final prefix are scored exactly on the original
vectors, and the best k over all trees remain.

Equal vectors collapse to one entry that lists its k + 1 smallest ids, which is
all a result can need, and queries of one vector ask once, for k + 1 ids, before
each drops its own; so a vector of a third of all rows is one entry and one
question.  Every vector is indexed.  Range partitions hold about ``rows_per_partition`` entries.

Where not given, trees, quota and partition rows follow the number of different
vectors (:func:`plan`): a tree answers with the same share of the table whatever
its size, so its prefixes keep their length and recall does not fall as the
table grows (neighbours only get closer).

Edge cases: see :func:`cohortlens.llm.vectors.valid_vectors` (zero vectors take no
part); a query never finds its own id; ids repeated with one vector count once;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.vectors import valid_vectors

U = np.uint64
TOP = U(1 << 63)


#: A prefix is shared by 1 / SHARE of the entries, and by MIN_QUOTA at least and MAX_QUOTA at most.
SHARE, MIN_QUOTA, MAX_QUOTA, TREES = 64, 1200, 16_384, 32


def plan(n: int) -> tuple[int, int, int]:
    """(trees, quota, rows_per_partition) for n different vectors.

    Over SHARE * MAX_QUOTA (a million) vectors the quota stands still, which bounds
    a task's memory, and prefixes get longer; a near pair shares one more bit in
    two cases of three, so each doubling takes 1.5 times the trees (power 0.6).
    Partitions hold eight quotas, so few prefixes cross a range boundary.
    """
    quota = min(max(MIN_QUOTA, -(-n // SHARE)), MAX_QUOTA)
    trees = int(np.ceil(TREES * max(1.0, n / (SHARE * MAX_QUOTA)) ** 0.6))
    return trees, quota, max(16_384, 8 * quota)


def _planes(trees: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trees * 64, dims + 1))


def hash_strings(v: np.ndarray, extra: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """n x trees strings as uint64, first bit highest."""
    bits = (v @ planes[:, :-1].T + extra[:, None] * planes[:, -1]) > 0
    return np.packbits(bits.reshape(len(v), -1, 64), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def descend(keys: np.ndarray, wanted: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) in sorted ``keys`` of the longest prefix of each string that ``quota`` keys share."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    todo = np.arange(len(wanted))
    for bits in range(64, 0, -1):
        if not len(todo):
            break
        rest = U((1 << (64 - bits)) - 1)
        w = wanted[todo]
        a = np.searchsorted(keys, w & ~rest, side="left")
        b = np.searchsorted(keys, w | rest, side="right")
        enough = b - a >= quota
        lo[todo[enough]], hi[todo[enough]] = a[enough], b[enough]
        todo = todo[~enough]
    return lo, hi


def nearest(rows: DataFrame, is_query: Column, k: int = 20, trees: int | None = None,
            quota: int | None = None, seed: int = 3, rows_per_partition: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) over rows (vec_id, v array<double>)."""
    rows = rows.dropDuplicates(["vec_id", "v"])
    w = Window.partitionBy("v").orderBy("vec_id")
    listed = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"))
    listed = listed.select("v", "ids", F.lit(False).alias("asks"))
    queries = rows.where(is_query).select("v", F.col("vec_id").alias("query_id"))
    asked = queries.groupBy("v").agg(F.min("query_id").alias("q"))
    asking = asked.select("v", F.array("q").alias("ids"), F.lit(True).alias("asks"))
    both = common.materialize(listed.unionByName(asking), "vectors")
    stats = both.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"),
                     F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n"),
                     F.count_if(~F.col("asks")).alias("entries")).first()
    if not stats["n"]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).limit(0)
    top, dims = stats["m"], stats["d"]
    planned = plan(stats["entries"])
    trees, quota = trees or planned[0], quota or planned[1]
    rows_per_partition = rows_per_partition or max(planned[2], 8 * quota)

    def index(batches):
        planes = _planes(trees, dims, seed)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                b = batch.slice(at, 2048)
                v = b.column(0).flatten().to_numpy().reshape(len(b), -1)
                asks = b.column(2).to_numpy(zero_copy_only=False)
                extra = np.where(asks, 0.0, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0)))
                keys = (hash_strings(v, extra, planes) ^ TOP).view(np.int64)
                raw = pa.array([r.tobytes() for r in v], pa.binary())
                ids = pa.array([np.array(x, "<i8").tobytes() for x in b.column(1).to_pylist()], pa.binary())
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(b), t, np.int32)), pa.array(np.ascontiguousarray(keys[:, t])),
                         b.column(2), ids, raw], names=["tree", "key", "asks", "ids", "v"])

    parts = max(1, -(-stats["n"] * trees // rows_per_partition))
    forest = both.mapInArrow(index, "tree int, key long, asks boolean, ids binary, v binary")
    forest = forest.repartitionByRange(parts, "tree", "key").sortWithinPartitions("tree", "key", "asks", "ids")

    def search(batches):
        left = []
        for batch in batches:
            t = batch.column("tree").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
            for a, b in zip(edges[:-1], edges[1:]):
                if left and left[-1].column("tree")[0].as_py() != t[a]:
                    yield in_tree(pa.Table.from_batches(left))
                    left = []
                if b > a:
                    left.append(batch.slice(a, b - a))
        if left:
            yield in_tree(pa.Table.from_batches(left))

    def in_tree(t: pa.Table) -> pa.RecordBatch:
        asks = t.column("asks").to_numpy()
        keys = (t.column("key").to_numpy().view(np.uint64) ^ TOP)
        v = np.frombuffer(b"".join(x.as_py() for x in t.column("v")), np.float64).reshape(len(t), -1)
        ids = [np.frombuffer(x.as_buffer(), "<i8") for x in t.column("ids")]
        own = np.array([i[0] for i, a in zip(ids, asks) if a], dtype=np.int64)
        entry = np.flatnonzero(~asks)
        x, per = v[entry], np.array([len(ids[e]) for e in entry], dtype=np.int64)
        flat = np.concatenate([ids[e] for e in entry]) if len(entry) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(per)])
        lo, hi = descend(keys[entry], keys[asks], quota)
        q, out = v[asks], []
        for g in range(0, len(own), 32):  # neighbouring queries read one stretch of the array
            s, e = int(lo[g:g + 32].min()), int(hi[g:g + 32].max())
            if s >= e:
                continue
            score = q[g:g + 32] @ x[s:e].T
            for i in range(len(score)):
                a, b = int(lo[g + i]) - s, int(hi[g + i]) - s
                row = score[i, a:b]
                if not len(row):
                    continue
                near = np.flatnonzero(row >= -np.partition(-row, min(k, len(row) - 1))[min(k, len(row) - 1)])
                near = near[np.argsort(-row[near], kind="stable")]
                e_ = near + a + s
                who = flat[common.ragged(begin[e_], per[e_])]
                val = np.repeat(row[near], per[e_])
                best = np.lexsort((who, -val))[:k + 1]
                out.append((np.full(len(best), own[g + i]), who[best], val[best]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind)
                for i, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "vec_id", "score"])

    found = forest.mapInArrow(search, "q long, vec_id long, score double")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")
    found = (queries.join(asked, "v").select("query_id", "q").join(found, "q").where("vec_id <> query_id")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = valid_vectors(common.embeddings(spark, sf_dir), nonzero=True)
    return nearest(v, F.col("vec_id") % 20 == 0)
