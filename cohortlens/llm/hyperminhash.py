"""MinHash near-dedup with HyperMinHash registers.

A document's set holds the 64-bit hashes of its distinct word shingles.  The
hash space is split into 128 buckets; a bucket's register stores, of its
smallest hash, the number of leading zeros (6 bits) and the 10 bits after the
leading one.  Empty buckets borrow the register of another bucket along a fixed
probe order.  Twenty-five bands of five registers give candidate pairs; the
Jaccard estimate over the 128 registers, corrected for chance collisions of
compressed registers, thins them; surviving pairs are confirmed on the full
sets.  At the threshold 0.85 a pair is missed by all bands with probability
below 1e-6, and by the estimate (kept five standard errors below the threshold)
with probability below 1e-6.

Scale: equal sets first collapse to one representative.  In a band bucket each
member is linked to its smallest member only; links are confirmed and connected;
buckets of three or more whose members still lie in different components are
then compared completely, in blocks of about BLOCK members and BLOCK_SHINGLES
shingles per side: one pass of estimates finds the members that have a possible
partner in another component, a second compares their full sets inside the task
and emits links that connect them, fewer than members.  So copies are never
expanded into pairs and no link between components is lost.  Full sets are only
computed and moved for documents named by :class:`common.IdFilter`.  Everything kept
between steps is written to the shared folder.

Edge cases: null and empty texts, and texts of white space, have an empty set
and link with nothing; fewer words than a shingle give the whole sequence as one
shingle; rows sharing a doc_id count as one document for linking, each keeps its
row; rows with null doc_id link with nothing and are kept (component null);
extra columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.components import components

BUCKETS, BANDS, ROWS = 128, 25, 5
MANTISSA = 10
GROUP_BYTES = 2_000_000
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
U = np.uint64
WORD_BASE, K1, K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_PROBES = np.argsort(common.mix64(np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS) + U(11)), axis=1)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int):
    """Sorted distinct shingle hashes of the texts data[off[i]:off[i+1]], and counts per text."""
    n = len(off) - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    solid = np.flatnonzero(~space)
    counts = np.zeros(n, dtype=np.int64)
    if not len(solid):
        return np.zeros(0, np.uint64), counts
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))[solid]
    first = np.ones(len(solid), dtype=bool)
    first[1:] = (np.diff(solid) > 1) | (np.diff(doc) > 0)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(solid)))
    place = np.arange(len(solid)) - np.repeat(at, size)
    power = np.concatenate([[U(1)], np.full(int(size.max()) - 1, WORD_BASE)]).cumprod(dtype=np.uint64)
    h = common.mix64(np.add.reduceat((low[solid].astype(np.uint64) + U(1)) * power[place], at))
    own = doc[at]
    per = np.bincount(own, minlength=n)
    begin = np.concatenate([[0], np.cumsum(per)[:-1]])
    full = per >= words
    starts = common.ragged(begin[full], per[full] - words + 1)
    s = np.full(len(starts), K2, dtype=np.uint64)
    for j in range(words):
        s = (s ^ h[starts + j]) * K1 + U(j)
    owner = own[starts]
    few = np.flatnonzero((per > 0) & ~full)
    if len(few):  # the whole sequence, marked by its length
        t = common.mix64(per[few].astype(np.uint64))
        for j in range(words - 1):
            more = per[few] > j
            t[more] = (t[more] ^ h[begin[few][more] + j]) * K1 + U(j)
        s, owner = np.concatenate([s, t]), np.concatenate([owner, few])
    s = common.mix64(s)
    order = np.argsort(s, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16) if n <= 65536 else owner[order], kind="stable")]
    s, owner = s[order], owner[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[keep], np.bincount(owner[keep], minlength=n)


def registers(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """n x BUCKETS uint16 registers (zero rows for empty sets) of sorted sets."""
    n = len(counts)
    out, filled = np.zeros((n, BUCKETS), dtype=np.uint16), np.zeros((n, BUCKETS), dtype=bool)
    if len(sets):
        doc = np.repeat(np.arange(n), counts)
        bucket = (sets >> U(57)).astype(np.int64)
        lead = np.ones(len(sets), dtype=bool)
        lead[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
        v, doc, bucket = (sets[lead] << U(7)) | U(64), doc[lead], bucket[lead]
        zeros = 53 - np.frexp((v >> U(11)).astype(np.float64))[1]
        zeros = np.where(v >> U(11) == 0, 53, zeros).astype(np.uint64)
        mantissa = ((v << zeros) << U(1)) >> U(64 - MANTISSA)
        out[doc, bucket] = ((zeros << U(MANTISSA)) | mantissa).astype(np.uint16)
        filled[doc, bucket] = True
    real, source = filled.copy(), out.copy()
    rows, cols = np.nonzero(~filled & (counts > 0)[:, None])
    for t in range(BUCKETS):
        if not len(rows):
            break
        probe = _PROBES[cols, t]
        hit = real[rows, probe]
        out[rows[hit], cols[hit]] = source[rows[hit], probe[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """n x BANDS int64 keys."""
    part = regs[:, :BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + U(1), part.shape[:2]).copy()
    for j in range(ROWS):
        key = common.mix64(key * K1 + part[:, :, j])
    return key.view(np.int64)


def estimate(same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, without the chance collisions.

    Two registers of independent sets agree with probability about
    0.72 * 2**-MANTISSA * na * nb / (na + nb)**2: cells are 0.72 * 2**-MANTISSA
    of their position wide on average, and minima are exponential.
    """
    chance = 0.72 * 2.0 ** -MANTISSA * na * nb / np.maximum(na + nb, 1.0) ** 2
    return (same - chance) / (1 - chance)


def _groups(off: np.ndarray) -> list:
    """(from, to) slices of about GROUP_BYTES bytes, at least one text each."""
    out, start = [], 0
    while start < len(off) - 1:
        end = max(start + 1, int(np.searchsorted(off, off[start] + GROUP_BYTES, side="right")) - 1)
        out.append((start, end))
        start = end
    return out


def _each_group(column: pa.Array, words: int):
    """(from, to, sets, counts) over slices of a text column."""
    data, off = common.utf8(column)
    for a, b in _groups(off):
        sets, counts = shingle_sets(data[off[a]:off[b]], off[a:b + 1] - off[a], words)
        yield a, b, sets, counts


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, regs, keys): f1 and f2 identify the set."""

    def run(batches):
        for batch in batches:
            for a, b, sets, counts in _each_group(batch.column(1), words):
                ends = np.cumsum(counts)
                marks = []
                for salt in (U(3), U(5)):
                    total = np.concatenate([[U(0)], np.cumsum(common.mix64(sets + salt), dtype=np.uint64)])
                    marks.append((total[ends] - total[ends - counts]).view(np.int64))
                regs = registers(sets, counts)
                keys = band_keys(regs)
                where = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(counts), pa.array(marks[0]), pa.array(marks[1]),
                     pa.array([r.tobytes() for r in regs], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(where), pa.array(keys[counts > 0].ravel()))],
                    names=["doc_id", "n_shingles", "f1", "f2", "regs", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, regs binary, keys array<long>")


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype).reshape(-1, width)


def thinned(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate allow the threshold."""
    low = _least_estimate(threshold)
    a = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
    b = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
    j = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def run(batches):
        for x in batches:
            ra, rb = _matrix(x.column("ra"), np.uint16, BUCKETS), _matrix(x.column("rb"), np.uint16, BUCKETS)
            na, nb = x.column("na").to_numpy().astype(float), x.column("nb").to_numpy().astype(float)
            ok = estimate((ra == rb).mean(axis=1), na, nb) >= low
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(ok)), x.column("b").filter(pa.array(ok))],
                                             names=["a", "b"])

    return j.mapInArrow(run, "a long, b long")


def shingle_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, s): full sets, as bytes, of the documents in ``ids`` (doc_id)."""
    wanted = common.IdFilter(ids, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        for batch in batches:
            ok = shared.value.passes(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            batch = batch.filter(pa.array(ok))
            for a, b, s, counts in _each_group(batch.column(1), words):
                raw = s.tobytes()
                at = np.concatenate([[0], np.cumsum(counts)]) * 8
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())],
                    names=["doc_id", "s"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    rows = rows.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(wanted.hashes("doc_id"))])
    return common.materialize(rows.mapInArrow(sets, "doc_id long, s binary").join(ids, "doc_id", "left_semi"), "sets")


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([p, q]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets of their texts."""
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    have = shingle_table(docs, needed, words)
    j = (pairs.join(have.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
         .join(have.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))

    def run(batches):
        for x in batches:
            ok = pa.array([_linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64),
                                   percent) for p, q in zip(x.column("sa"), x.column("sb"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], names=["a", "b"])

    return j.mapInArrow(run, "a long, b long")


class Block:
    """Members of one band bucket (or of a pair of its blocks), and which of their pairs are due here."""

    def __init__(self, t: pa.Table, threshold: float):
        self.low, self.threshold = _least_estimate(threshold), threshold
        self.regs = _matrix(t.column("regs"), np.uint16, BUCKETS)
        self.rep, self.component = t.column("rep").to_numpy(), t.column("component").to_numpy().copy()
        self.n = t.column("n_shingles").to_numpy().astype(float)
        self.second = t.column("second").to_numpy()
        self.keys = band_keys(self.regs)
        self.band = int(np.flatnonzero(self.keys[0] == t.column("k")[0].as_py())[0])
        self.diagonal = t.column("x")[0].as_py() == t.column("y")[0].as_py()

    def partners(self, i: int) -> np.ndarray:
        """Members of other components whose estimate with i passes, if this is the pair's first shared band."""
        if self.diagonal:
            o = np.arange(i + 1, len(self.rep))
        elif self.second[i]:
            return np.zeros(0, dtype=np.int64)
        else:
            o = np.flatnonzero(self.second)
        n = self.n
        o = o[(self.component[o] != self.component[i])
              & (np.minimum(n[o], n[i]) >= self.threshold * np.maximum(n[o], n[i]) - 1e-9)]
        if not len(o):
            return o
        o = o[estimate((self.regs[o] == self.regs[i]).mean(axis=1), n[o], np.full(len(o), n[i])) >= self.low]
        return o[(self.keys[o] == self.keys[i]).argmax(axis=1) == self.band]


def _least_estimate(threshold: float) -> float:
    return threshold - 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def _each_block(batches):
    """Tables of the rows of one (k, x, y), from batches in that order."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]) if left is not None else t
        k, x, y = (t.column(c).to_numpy() for c in ("k", "x", "y"))
        edges = [0, *((np.flatnonzero((np.diff(k) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist())]
        for a, b in zip(edges[:-1], edges[1:]):
            yield t.slice(a, b - a).combine_chunks()
        left = t.slice(edges[-1])
    if left is not None and len(left):
        yield left.combine_chunks()


def open_members(shared: DataFrame, reps: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """Block members with a pair across components that was not yet compared and may reach the threshold."""
    named = (shared.where("n > 2").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    mixed = (named.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("k"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    m = named.join(mixed, "k", "left_semi").where("rep <> hub").withColumn("blocks", blocks)
    m = m.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    m = m.select("k", "rep", "component", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    m = m.select("k", "rep", "component", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"),
                 (F.col("i") > F.col("j")).alias("second"))
    m = m.join(reps.select("rep", "n_shingles", "regs"), "rep")
    m = m.select("k", "x", "y", "second", "rep", "component", "n_shingles", "regs")

    def run(batches):
        for t in _each_block(batches):
            block, due = Block(t, threshold), np.zeros(len(t), dtype=bool)
            for i in range(len(t)):
                o = block.partners(i)
                due[o] = True
                due[i] |= len(o) > 0
            if due.any():
                yield from t.filter(pa.array(due)).to_batches()

    return m.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(run, m.schema)


def linked_members(members: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links (a, b) that connect the members of each block as their full sets do, at most one fewer than members."""
    m = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select(*members.columns, "s")

    def run(batches):
        for t in _each_block(batches):
            block, out = Block(t, threshold), []
            s = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
            for i in range(len(t)):
                o = block.partners(i)
                while len(o):
                    j = int(o[0])
                    if _linked(s[i], s[j], percent):
                        out.append((int(block.rep[i]), int(block.rep[j])))
                        block.component[block.component == block.component[j]] = block.component[i]
                    o = o[1:][block.component[o[1:]] != block.component[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()),
                                              pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

    return m.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: components of documents linked at percent."""
    threshold = percent / 100
    sig = common.materialize(sketches(docs, words), "sketches")
    full = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = common.materialize(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = (full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "f1", "f2"], "left_semi")
            .select(F.col("doc_id").alias("rep"), "n_shingles", "regs", "keys"))
    bands = reps.select("rep", "n_shingles", F.explode("keys").alias("k"))
    buckets = (bands.groupBy("k").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n"),
                                      F.sum("n_shingles").alias("shingles")).where("n > 1"))
    shared = common.materialize(bands.select("k", "rep").join(buckets, "k"), "shared")
    star = shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    found = common.materialize(thinned(star, reps, threshold), "pairs").distinct()
    links = common.materialize(confirmed(found, docs, words, percent), "confirmed")
    label = components(links)
    members = common.materialize(open_members(shared, reps, label, threshold), "members")
    if members.take(1):
        sets = shingle_table(docs, members.select(F.col("rep").alias("doc_id")).distinct(), words)
        more = linked_members(members, sets, threshold, percent)
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component"))
    own = sig.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each component of near-duplicates.

    Rows are linked by a key of their own, so rows without a doc_id and rows that
    repeat one take part like others.  Of a component the row of the smallest doc_id
    stays (rows without one last; among equals, the first written).
    """
    # the key is written with the rows: every later read sees the same one
    keyed = common.materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                                           F.monotonically_increasing_id().alias("__key")), "keyed")
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), F.col("__row.text").alias("text")), words, percent)
    gone = common.materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("__key"), "component_id"), "gone")
    members = gone.unionByName(gone.select(F.col("component_id").alias("__key"), "component_id").distinct())
    own = keyed.select("__key", F.col("__row.doc_id").alias("id")).join(members, "__key")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "__key")
    stay = own.groupBy("component_id").agg(F.min(rank).alias("first")).select(F.col("first.__key").alias("__key"))
    drop = members.select("__key").join(stay, "__key", "left_anti")
    left = keyed.join(drop, "__key", "left_anti")
    return left.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), words=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(sh) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON s.doc_id = m.a
"""
