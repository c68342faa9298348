"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

Every byte covered by a string of ``length`` bytes that starts at more than one
place is removed.  Sorting all suffixes would move ``length`` bytes per byte, so
a content-defined subset is sorted: each start of a ``length``-byte string picks
as its anchor the leftmost smallest 16-byte hash among its first WINDOW
positions.  Equal strings pick anchors at equal distances, hence two equal
strings have anchors whose suffixes share at least ``length - WINDOW`` bytes;
nothing is lost by sorting only the anchors' suffixes.

1. Anchors of all texts with a hash of the bytes their suffixes must share;
   hashes found once are dropped (grouped count, combined map-side).
2. For the rest, each task cuts the context an anchor decides on (bytes before
   it and its suffix, ``length`` bytes of reach), merges equal contexts into one
   entry with a list of places, sorts the entries by suffix and sends them, front
   coded (shared-prefix length and remaining bytes), to the bucket of their hash.
3. Each bucket merges its sorted runs with a loser tree that carries the shared
   prefix of every entry with the last winner: entries are ordered by that length
   alone, and bytes are read only beyond prefixes known to be equal.  It yields
   the suffix array of the bucket with its shared-prefix array.
4. Neighbours sharing ``length - WINDOW`` bytes form a group; a string decided on
   by one of its entries is repeated if the entry has several places or another
   entry holds the same bytes at the same distance (compared exactly).
5. Repeated strings become intervals of their document, which are merged and cut.

A passage of many short words can be shared and yet be shorter than ``length``
bytes.  Such ones are counted, not cut, by winnowing: of every ``words`` words the
leftmost smallest hash of a string of PASSAGE words is selected, and ``n_shared``
is the number of different selected strings of a document that another document
selects too (same words, any ASCII whitespace between them).  Two documents that
share ``words`` words select the same string of them, so each counts at least one;
documents sharing fewer than PASSAGE words count none.  Strings are told by 64-bit
hashes.  Rows of one id and equal text are one document here.

A hash of more than ``hot`` anchors (a passage of very many documents, a periodic
text) would put all of its contexts, which differ around the passage, into one
bucket.  Its anchors are split by the single strings they decide on: a task finds
those repeated among its own documents, cuts them there and sends one row without
a place for each; the other strings go, as two 64-bit hashes and their place, to
the bucket of their own hash, where the counts of all tasks meet.  So a bucket
holds at most ``hot`` contexts of one hash, and of one string one row a task.
Either way finds the same strings; texts are only moved by their own row key,
intermediate tables go to the shared folder.

Edge cases: null texts count as empty, texts shorter than ``length`` are kept
whole; a row repeated in the table is another place; null doc_ids are allowed;
periodic texts only make more anchors; extra columns are not used.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common

U = np.uint64
GRAM = 16
GROUP_BYTES = 2_000_000
RUN_BYTES = 48_000_000
HOT = 8192
STRINGS_PER_BUCKET = 500_000
_TABLE = common.mix64(np.arange(256, dtype=np.uint64) + U(77))
_BASE = U(0x9E3779B97F4A7C15)
NULL_ID = -(1 << 63)
WORDS = 50
PASSAGE = 40
_UNBASE = U(pow(int(_BASE), -1, 1 << 64))


def anchors(data: np.ndarray, off: np.ndarray, length: int, window: int):
    """(text index, position in data, nearest distance, farthest distance) of every anchor.

    The strings an anchor decides on start ``nearest`` to ``farthest`` bytes
    before it.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    size = np.diff(off)
    if not len(size) or size.max() < length:
        return none
    h, power, step = _TABLE[data], _BASE, 1
    while step < GRAM:
        h = h[:-step] * power + h[step:]
        power, step = U(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), step * 2
    h = (common.mix64(h) & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < window:
        h = np.minimum(h[:len(h) - (window - span)], h[window - span:])
    long = np.flatnonzero(size >= length)
    starts = common.ragged(off[long], size[long] - length + 1)
    doc = np.repeat(long, size[long] - length + 1)
    at = (h[starts] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], at[first] - starts[last], at[first] - starts[first]


def shared_hash(data: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n bytes (a multiple of 8) from each position."""
    if not len(at):
        return np.zeros(0, np.int64)
    out = []
    for a in range(0, len(at), 100_000):
        words = np.lib.stride_tricks.sliding_window_view(data, n)[at[a:a + 100_000]].view(np.uint64)
        h = np.full(len(words), U(n + (seed << 32)), dtype=np.uint64)
        for j in range(words.shape[1]):
            h = common.mix64(h ^ words[:, j]) + _BASE
        out.append(h)
    return np.concatenate(out).view(np.int64)


def string_hash(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position."""
    n = length // 8 * 8
    h = shared_hash(data, at, n, seed)
    if n == length:
        return h
    tail = shared_hash(data, at + (length - n), n, seed + 1)
    return common.mix64(h.view(np.uint64) * _BASE ^ tail.view(np.uint64)).view(np.int64)


class Strings:
    """Single strings of hot anchors: hashes, place (rid, h, start; start -1: no place) and count."""

    def __init__(self):
        self.rows: list = []
        self.count = 0

    def add(self, raw: bytes, rid: int, h: int, at: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> None:
        starts = common.ragged(at - far, far - near + 1)
        data = np.frombuffer(raw, dtype=np.uint8)
        n = len(starts)
        self.rows.append(np.column_stack([
            string_hash(data, starts, length, 1), string_hash(data, starts, length, 3),
            np.full(n, rid), np.full(n, h), starts, np.ones(n, dtype=np.int64)]))
        self.count += n


def by_string(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by string, first row of each string, count of each string."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    first = np.flatnonzero(new)
    return rows, first, np.add.reduceat(rows[:, 5], first)


def covered(places: np.ndarray, length: int) -> np.ndarray:
    """(rid, h, s, e) intervals of the strings at places (rid, h, start), merged within a document."""
    if not len(places):
        return np.zeros((0, 4), dtype=np.int64)
    p = places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:, :2] != p[:-1, :2]).any(axis=1) | (p[1:, 2] > p[:-1, 2] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return np.column_stack([p[first], p[last, 2] + length])


def split_strings(strings: Strings, buckets: int, length: int) -> list:
    """(negative bucket, packed rows) of a task's strings.

    What repeats within the task is cut here and sent once without a place.
    """
    if not strings.count:
        return []
    rows, first, n = by_string(np.concatenate(strings.rows))
    twice = np.repeat(n > 1, np.diff(np.append(first, len(rows))))
    cut = covered(rows[twice, 2:5], length)
    seen = rows[first[n > 1]]
    seen[:, 2:5], seen[:, 5] = (0, 0, -1), 2
    rest = np.concatenate([rows[~twice], seen])
    parts: dict = {}
    for kind, table, by in ((0, cut, 1), (1, rest, 0)):
        deal = (np.ascontiguousarray(table[:, by]).view(np.uint64) % U(buckets)).astype(np.int64) if len(table) else np.zeros(0, np.int64)
        order = np.argsort(deal, kind="stable")
        found, begin = np.unique(deal[order], return_index=True)
        for b, own in zip(found.tolist(), np.split(table[order], begin[1:])):
            parts.setdefault(b, [cut[:0], rest[:0]])[kind] = own
    return [(-1 - b, zstandard.ZstdCompressor(level=1).compress(
        len(c).to_bytes(8, "little") + c.tobytes() + r.tobytes())) for b, (c, r) in parts.items()]


def merge_strings(blobs: list, length: int) -> np.ndarray:
    """(rid, h, s, e) intervals of strings counted more than once over all tasks, and of those cut there."""
    cuts, rows = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        cuts.append(np.frombuffer(raw, "<i8", n * 4, 8).reshape(n, 4))
        rows.append(np.frombuffer(raw, "<i8", -1, 8 + n * 32).reshape(-1, 6))
    rows = np.concatenate(rows)
    if len(rows):
        rows, first, n = by_string(rows)
        again = np.repeat(n > 1, np.diff(np.append(first, len(rows)))) & (rows[:, 4] >= 0)
        cuts.append(covered(rows[again, 2:5], length))
    return np.concatenate(cuts)


def _groups(off: np.ndarray) -> list:
    out, start = [], 0
    while start < len(off) - 1:
        end = max(start + 1, int(np.searchsorted(off, off[start] + GROUP_BYTES, side="right")) - 1)
        out.append((start, end))
        start = end
    return out


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    end = min(len(a), len(b))
    while at < end:
        step = min(32, end - at)
        if a[at:at + step] == b[at:at + step]:
            at += step
            continue
        while a[at] == b[at]:
            at += 1
        return at
    return at


class Run:
    """A sorted run in decoding: current suffix, its prefix shared with the last winner, record."""

    __slots__ = ("entries", "pos", "suffix", "known", "rest")

    def __init__(self, blob: bytes):
        self.entries = decode(blob)
        self.pos, self.suffix, self.known, self.rest = -1, b"", 0, None
        self.advance()

    def advance(self) -> None:
        """Next entry; its coded prefix is the one shared with the entry just taken."""
        self.pos += 1
        if self.pos < len(self.entries):
            self.known, tail, self.rest = self.entries[self.pos]
            self.suffix = self.suffix[:self.known] + tail
        else:
            self.suffix, self.rest = None, None


def _wins(a: Run, b: Run) -> bool:
    """Whether a comes before b; the loser's ``known`` becomes its prefix shared with the winner.

    Both prefixes refer to the last overall winner, which precedes both: the
    entry sharing more with it is smaller, and the shorter prefix is also what
    the two share.  Only equal lengths need bytes, from there on.
    """
    if b.suffix is None:
        return True
    if a.suffix is None:
        return False
    if a.known != b.known:
        return a.known > b.known
    n = shared_prefix(a.suffix, b.suffix, a.known)
    first = a.suffix[n:n + 1] <= b.suffix[n:n + 1]
    (b if first else a).known = n
    return first


def merge_runs(blobs: list):
    """Yields (prefix shared with the previous suffix, suffix, record) of all runs in order."""
    runs = [Run(b) for b in blobs]
    k = 1
    while k < len(runs):
        k *= 2
    tree: list = [None] * k  # losers; leaves k.. are the runs

    def play(node: int):
        if node >= k:
            return runs[node - k] if node - k < len(runs) else None
        a, b = play(2 * node), play(2 * node + 1)
        if b is None or (a is not None and _wins(a, b)):
            tree[node] = b
            return a
        tree[node] = a
        return b

    top = play(1) if k > 1 else (runs[0] if runs else None)
    place = {id(r): i + k for i, r in enumerate(runs)}
    while top is not None and top.suffix is not None:
        yield top.known, top.suffix, top.rest
        top.advance()
        node = place[id(top)] // 2
        while node >= 1:
            other = tree[node]
            if other is not None and not _wins(top, other):
                tree[node], top = top, other
            node //= 2


def encode(entries: list) -> bytes:
    """Front-coded, compressed run of sorted (suffix, before, nearest, farthest, places)."""
    n = len(entries)
    head = np.zeros((n, 6), dtype="<u4")
    tails, befores, places, last = [], [], [], b""
    for i, (suffix, before, near, far, where) in enumerate(entries):
        p = shared_prefix(last, suffix, 0)
        head[i] = (p, len(suffix) - p, len(before), near, far, len(where))
        tails.append(suffix[p:])
        befores.append(before)
        places += where
        last = suffix
    body = b"".join([n.to_bytes(4, "little"), head.tobytes(), np.array(places, dtype="<i8").tobytes(), *tails, *befores])
    return zstandard.ZstdCompressor(level=1).compress(body)


def decode(blob: bytes) -> list:
    """(shared prefix, remaining bytes, (before, nearest, farthest, places)) per entry."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, "<u4", n * 6, 4).reshape(n, 6).astype(np.int64)
    at = 4 + n * 24
    total = int(head[:, 5].sum())
    places = np.frombuffer(raw, "<i8", total * 3, at).reshape(total, 3)
    tail = at + total * 24
    before = tail + int(head[:, 1].sum())
    out, p = [], 0
    for shared, rest, left, near, far, count in head.tolist():
        out.append((shared, raw[tail:tail + rest], (raw[before:before + left], near, far, places[p:p + count])))
        tail, before, p = tail + rest, before + left, p + count
    return out


def repeated_starts(group: list, length: int):
    """(places, nearest, farthest) runs of distances whose string occurs more than once.

    ``group``: (suffix, before, nearest, farthest, places array), suffixes sharing a prefix.
    """
    merged: dict = {}
    for suffix, before, near, far, where in group:
        merged.setdefault((suffix, before, near, far), []).append(where)
    entries = [(k, np.concatenate(v) if len(v) > 1 else v[0]) for k, v in merged.items()]
    if len(entries) == 1:
        (_, _, near, far), where = entries[0]
        if len(where) > 1:
            yield where, near, far
        return
    seen: dict = {}
    for (suffix, before, near, far), where in entries:
        whole, left = before + suffix, len(before)
        for o in range(near, far + 1):
            key = (o, whole[left - o:left - o + length])
            seen[key] = seen.get(key, 0) + 1
    for (suffix, before, near, far), where in entries:
        if len(where) > 1:
            yield where, near, far
            continue
        whole, left, start = before + suffix, len(before), None
        for o in range(near, far + 2):
            hit = o <= far and seen[(o, whole[left - o:left - o + length])] > 1
            if hit and start is None:
                start = o
            elif not hit and start is not None:
                yield where, start, o - 1
                start = None


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts laid end to end, and each text's first word (n + 1 entries)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    edges = off[:-1][np.diff(off) > 0]
    new[edges] = inside[edges]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(new[at])
    size = np.diff(np.append(first, len(at)))
    powers = np.multiply.accumulate(np.full(int(size.max()), _BASE, dtype=np.uint64))
    place = np.arange(len(at)) - np.repeat(first, size)
    return (common.mix64(np.add.reduceat(_TABLE[data[at]] * powers[place], first)),
            np.searchsorted(at[first], off))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word that has so many after it."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    one = np.ones(1, dtype=np.uint64)
    up = np.multiply.accumulate(np.append(one, np.full(len(h) - 1, _BASE, dtype=np.uint64)))
    down = np.multiply.accumulate(np.append(one, np.full(len(h) - n, _UNBASE, dtype=np.uint64)))
    total = np.append(np.zeros(1, np.uint64), np.add.accumulate(h * up))
    return common.mix64((total[n:] - total[:-n]) * down + U(n))


def selected_strings(data: np.ndarray, off: np.ndarray, words: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the different strings of ``size`` words that texts select."""
    h, begin = word_hashes(data, off)
    grams, window = gram_hashes(h, size), words - size + 1
    room = np.maximum(np.diff(begin) - words + 1, 0)
    starts = common.ragged(begin[:-1], room)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < window:
        least = np.minimum(least[:len(least) - (window - span)], least[window - span:])
    at = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    text, key = np.repeat(np.arange(len(room)), room), grams[at].view(np.int64)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[new], key[new]


class KeyFilter(common.IdFilter):
    """An IdFilter of keys that are hashes already."""

    @staticmethod
    def hashes(column: str) -> list:
        return [F.col(column), F.shiftrightunsigned(column, 36)]

    def holds(self, column: str):
        """A boolean column."""

        @F.pandas_udf("boolean")
        def check(keys: pd.Series) -> pd.Series:
            own = keys.to_numpy(dtype=np.int64)
            return pd.Series(self.passes(own, (own.view(np.uint64) >> U(36)).view(np.int64)))

        return check(column)


def _keyed(docs: DataFrame) -> DataFrame:
    """(rid, h, text): id and text hash of every row, the text as given (null: empty)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"),
                       F.xxhash64("text").alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(rid, h, n_shared) of documents with selected strings that another document selects too."""
    base = _keyed(docs).withColumn("d", F.xxhash64("rid", "h"))
    size = max(1, min(PASSAGE, words - words // 5))

    def select(batches):
        for batch in batches:
            data, off = common.utf8(batch.column(1))
            d = batch.column(0).to_numpy()
            for a, b in _groups(off):
                text, key = selected_strings(data[off[a]:off[b]], off[a:b + 1] - off[a], words, size)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(d[a:b][text])], names=["key", "d"])

    rows = common.materialize(base.select("d", "text").mapInArrow(select, "key long, d long"), "strings")
    shared = rows.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("key")
    shared = common.materialize(shared, "shared")
    count = (rows.where(KeyFilter(shared, "key").holds("key")).join(shared, "key")
             .groupBy("d").agg(F.count(F.lit(1)).alias("found")))
    # equal rows of a document have found the same strings
    copies = base.groupBy("d", "rid", "h").agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(count, "d").select("rid", "h", F.expr("found div copies").alias("n_shared"))


def removable(docs: DataFrame, length: int = 400, hot: int = HOT, words: int = WORDS) -> DataFrame:
    """Rows (rid, h, text, marks, n_shared): text as given (null: empty), marks array<struct<s,e>> of bytes to cut."""
    window = min(length - GRAM, max(1, length // 2 - 8))
    need = (length - window + 1) // 8 * 8  # bytes that suffixes of equal strings share at least
    base = _keyed(docs)

    def find(batches):
        for batch in batches:
            data, off = common.utf8(batch.column(2))
            rid, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _groups(off):
                part = data[off[a]:off[b]]
                doc, at, near, far = anchors(part, off[a:b + 1] - off[a], length, window)
                key = shared_hash(part, at, need)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[a:b][doc]), pa.array(h[a:b][doc]), pa.array(key),
                     pa.array((at - off[a:b][doc] + off[a]).astype(np.int32)),
                     pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16))],
                    names=["rid", "h", "key", "at", "near", "far"])

    found = common.materialize(base.mapInArrow(
        find, "rid long, h long, key long, at int, near short, far short"), "anchors")
    twice = common.materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                               .select("key", (F.col("n") > hot).alias("hot")), "repeated")
    # twice is a table, so nothing lies between the join and its shuffles: a hot hash's rows are split
    # a filter keeps most others from the shuffle
    again = found.where(KeyFilter(twice, "key").holds("key"))
    places = again.join(twice, "key").groupBy("rid", "h").agg(
        F.collect_set(F.struct("key", "at", "near", "far", "hot")).alias("anchors"))
    places = common.materialize(places, "places")
    singles = F.aggregate(F.filter("anchors", lambda x: x["hot"]), F.lit(0).cast("long"),
                          lambda a, x: a + x["far"] - x["near"] + 1)
    count = places.agg(F.sum(F.size("anchors")).alias("n"), F.sum(singles).alias("strings")).first()
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, (count["n"] or 0) // 4000 + 1)
    hot_buckets = max(least, (count["strings"] or 0) // STRINGS_PER_BUCKET + 1)

    def runs(batches):
        entries: dict = {}
        strings, size = Strings(), 0
        for batch in batches:
            anchors_ = batch.column(3)
            for rid, h, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                           batch.column(2), anchors_):
                raw = text.as_buffer().to_pybytes()
                *fields, single = marks.values.flatten()
                single = single.to_numpy(zero_copy_only=False)
                if single.any():
                    at, near, far = (f.to_numpy()[single].astype(np.int64) for f in fields[1:])
                    strings.add(raw, rid, h, at, near, far, length)
                    size += 64 * int((far - near + 1).sum())
                for key, at, near, far in zip(*(f.to_numpy()[~single].tolist() for f in fields)):
                    own = entries.setdefault(key % buckets, {})
                    e = (raw[at:at + length - near], raw[at - far:at], near, far)
                    if e not in own:
                        own[e] = []
                        size += 2 * length
                    own[e].append((rid, h, at))
                    size += 64
                if size > RUN_BYTES:
                    yield _blocks(entries, split_strings(strings, hot_buckets, length))
                    entries, strings, size = {}, Strings(), 0
        yield _blocks(entries, split_strings(strings, hot_buckets, length))

    # only texts that have a place move; the join settles what the filter lets pass
    d = F.xxhash64("rid", "h").alias("d")
    chosen = base.select("*", d).where(KeyFilter(places.select(d), "d").holds("d")).drop("d")
    joined = chosen.join(places, ["rid", "h"]).select("rid", "h", "text", "anchors")
    blocks = joined.mapInArrow(runs, "bucket long, run binary")

    def merge(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            w = merge_strings(t.column("run").to_pylist(), length)
            return pa.table({c: pa.array(np.ascontiguousarray(w[:, i])) for i, c in enumerate(("rid", "h", "s", "e"))})
        out, group = [], []

        def close():
            if len(group) > 1 or (group and len(group[0][4]) > 1):
                for where, near, far in repeated_starts(group, length):
                    out.append((where, near, far))
            group.clear()

        for shared, suffix, (before, near, far, where) in merge_runs(t.column("run").to_pylist()):
            if shared < need:
                close()
            group.append((suffix, before, near, far, where))
        close()
        if not out:
            return pa.table({c: pa.array([], pa.int64()) for c in ("rid", "h", "s", "e")})
        n = np.array([len(w) for w, _, _ in out])
        w = np.concatenate([w for w, _, _ in out])
        near, far = (np.repeat(np.array([x[i] for x in out]), n) for i in (1, 2))
        return pa.table({"rid": w[:, 0], "h": w[:, 1], "s": w[:, 2] - far, "e": w[:, 2] - near + length})

    cut = blocks.groupBy("bucket").applyInArrow(merge, "rid long, h long, s long, e long")
    cut = cut.groupBy("rid", "h").agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    found = common.materialize(cut.join(shared_words(docs, words), ["rid", "h"], "full"), "cuts")
    holds, rows = KeyFilter(found.select(d), "d").holds("d"), base.select("*", d)
    touched = rows.where(holds).join(found, ["rid", "h"], "left")
    others = rows.where(~holds).select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("marks", "n_shared")])
    return touched.unionByName(others).drop("d").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long")))


def _blocks(entries: dict, split: list) -> pa.RecordBatch:
    runs = [(b, encode(sorted((*e, w) for e, w in own.items()))) for b, own in entries.items()] + split
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in runs], pa.int64()),
                                       pa.array([r for _, r in runs], pa.binary())], names=["bucket", "run"])


def dedup_substrings(docs: DataFrame, length: int = 400, hot: int = HOT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<s,e>>, kept binary, n_shared) per row; ``hot`` changes no result."""

    def run(batches):
        for batch in batches:
            spans, kept, size = [], [], []
            for text, marks in zip(batch.column(2), batch.column(3)):
                raw = text.as_buffer().to_pybytes()
                size.append(len(raw))
                found = []
                if marks.is_valid:
                    for s, e in sorted(zip(*(f.to_pylist() for f in marks.values.flatten()))):
                        if found and s <= found[-1][1]:
                            found[-1][1] = max(found[-1][1], e)
                        else:
                            found.append([s, e])
                edges = [0, *[x for f in found for x in f], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"s": s, "e": e} for s, e in found])
            ids = [None if i == NULL_ID else i for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()),
                 pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                 pa.array(kept, pa.binary()), batch.column(4)],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_shared"])

    return removable(docs, length, hot, words).select("rid", "h", "text", "marks", "n_shared").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary, n_shared long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(common.documents(spark, sf_dir), 400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
