"""Exact top-k by inner product through no-random-access aggregation of sorted lists.

A block of rows holds one list a component, sorted once: its rows in order of that
component.  A query reads a list from the end where its weight makes contributions
largest, down to a depth, the same in all lists; queries of a batch read together, so
what is read at a depth is one matrix of entries (zero where nothing is read yet).
At each depth a row has a lower bound (what was read of it, plus the least entry of
the lists it was not met in) and an upper bound (what was read, plus the last entry
read of the others).  A query stops once no row that was never met can reach the
k-th best lower bound and at most 4 k rows have an upper bound that does; their
scores are then resolved from all their entries and the best k stay.  Other queries
read on at twice the depth.  At full depth everything has been read, so the result
is exact on any data.  How early queries stop depends on the data: a few components
that carry the score close the bounds soon, evenly spread ones late.

Rows and queries are dealt to blocks by a hash of their id; each (row block,
query block) pair is one task's group of bounded size, and it emits at most k
rows a query.  Ties go to the smaller id.

Edge cases: see :func:`cohortlens.llm.vectors.valid_vectors`; a query never
finds rows of its own id; rows repeated under one id count once if their
vectors are equal and each otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.vectors import valid_vectors

#: Queries that read together.
CHUNK = 64


class Lists:
    """The sorted lists of a block: for each component its rows from the highest entry and from the lowest."""

    def __init__(self, x: np.ndarray):
        self.x, self.sorted = x, np.sort(x, axis=0)
        self.rank = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0, kind="stable").astype(np.int32)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries over the lists' least, entries over the last read, last read) at a depth.

        Columns: the lists read from the top, for positive weights, then those read
        from the bottom, for negative ones; entries not read are 0 in both.
        """
        n = len(self.x)
        top, bottom = self.rank >= n - depth, self.rank < depth
        last = self.sorted[n - depth], self.sorted[depth - 1]
        least = self.sorted[0], self.sorted[-1]
        over = [np.concatenate([(self.x - e[0]) * top, (self.x - e[1]) * bottom], axis=1) for e in (least, last)]
        return over[0], over[1], np.concatenate(last)

    def best(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, first: int = 64):
        """(query, rows, scores, entries read) of each query's k best rows; ``own`` (queries x rows) are no candidates."""
        n, d = self.x.shape
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        least = signed @ np.concatenate([self.sorted[0], self.sorted[-1]])
        todo, depth = np.flatnonzero((~own).any(axis=1)), min(n, max(first, n // 16))
        while len(todo):
            over_least, over_last, last = self.read(depth)
            lower = least[todo, None] + signed[todo] @ over_least.T
            free = (~own[todo]).sum(axis=1)
            bar = np.array([np.partition(row[~o], f - min(k, f))[f - min(k, f)] for row, o, f in zip(lower, own[todo], free)])
            reach = signed[todo] @ last  # a row never met has this at most
            upper = reach[:, None] + signed[todo] @ over_last.T
            on = []
            for i, q in enumerate(todo.tolist()):
                close = np.flatnonzero((upper[i] >= bar[i]) & ~own[q])
                if depth < n and (reach[i] >= bar[i] or len(close) > 4 * k):
                    on.append(q)
                    continue
                score = self.x[close] @ queries[q]
                order = np.lexsort((ids[close], -score))[:k]
                yield q, close[order], score[order], depth * d
            todo, depth = np.array(on, dtype=np.int64), min(n, 2 * depth)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, rows_per_block: int = 8192,
          queries_per_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) over rows (vec_id, c array<long>)."""
    rows = common.materialize(rows.dropDuplicates(), "components")
    queries = rows.where(is_query)
    n = rows.count()
    nq = queries.count()
    rb, qb = max(1, -(-n // rows_per_block)), max(1, -(-nq // queries_per_block))
    left = rows.select("vec_id", "c", F.pmod(F.xxhash64("vec_id"), F.lit(rb)).cast("int").alias("rb"),
                       F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    right = queries.select("vec_id", "c", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(qb)).cast("int").alias("qb"))

    def matrix(t: pa.Table) -> np.ndarray:
        col = t.column("c").combine_chunks()
        return col.flatten().to_numpy().reshape(len(t), -1)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            x, y = matrix(a), matrix(b)
            ids, qids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            # every partial sum is exact in the narrowest kind that holds it
            size = 4.0 * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
            kind = np.float32 if size < 2 ** 24 else np.float64 if size < 2 ** 53 else np.int64
            lists, y = Lists(x.astype(kind)), y.astype(kind)
            for s in range(0, len(y), CHUNK):
                own = qids[s:s + CHUNK, None] == ids[None]
                for q, rows, scores, _ in lists.best(y[s:s + CHUNK], own, ids, k):
                    found += [(qids[s + q], i, int(v)) for i, v in zip(ids[rows].tolist(), scores.tolist())]
        return pa.table({n_: pa.array([f[i] for f in found], pa.int64())
                         for i, n_ in enumerate(("query_id", "vec_id", "score"))})

    best = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(
        search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = valid_vectors(common.embeddings(spark, sf_dir))
    rows = v.select("vec_id", F.transform("v", lambda x: F.floor(256 * x)).alias("c"))
    return top_k(rows, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.c, r.c)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
