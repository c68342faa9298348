"""Packing along a space-filling curve.

Each document is tokenised whole; its hashed token vector is projected to four
dimensions by signs drawn from a hash of (token, dimension), scaled to a grid,
and turned into a Hilbert key, so that similar documents get near keys.  The
tokenised table is written once; it is range-sorted by (key, doc_id, length) -
a group of copies shares one key, the further columns let the range partitioner
split it - and every partition streams its documents along the curve into
sequences of ``size`` tokens, cutting where a sequence is full.  The last open
sequence of a partition is cut into sequences of power-of-two length, so nothing
is padded at all.  The number of partitions follows the number of tokens.

Token ids are those of the ``tokenizers`` file.  Texts of common Latin
characters go through the same vocabulary's rank file (same ids, several times
faster; compared in the tests), all others through ``tokenizers`` itself.
Special-token strings inside a text are ordinary text.

Edge cases: null and empty texts hold only the end id; a document of any length
is cut freely; rows repeated under one doc_id are packed each; null doc_ids sort
first; an empty table packs to no piece; extra columns are not used.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common

END = 1
DIMS, BITS = 4, 15
#: Both tokenizers are known to agree on these characters.
COMMON = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")


def public_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of the byte-level vocabulary, built once per task."""

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list:
        if self.fast is not None and not COMMON.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def signs(ids: np.ndarray) -> np.ndarray:
    """n x DIMS signs from a hash of the token id."""
    h = common.mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((h[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index (int64) of n x d grid points with ``bits`` bits per dimension."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of each level
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: list) -> np.ndarray:
    """Hilbert key of each document's id array."""
    n = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    order = np.concatenate([[0], np.cumsum(n)])
    sums = np.add.reduceat(signs(flat), order[:-1], axis=0)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return hilbert(np.minimum(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenise(docs: DataFrame, vocabulary: str, ranks: str | None) -> DataFrame:
    """(doc_id, key, n, ids binary of unsigned 32-bit little-endian numbers) per row."""

    def run(batches):
        enc = Encoder(vocabulary, ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                part = [np.array([*enc.ids(t or ""), END], dtype="<u4") for t in texts[a:a + 256]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:a + 256], pa.array(curve_key(part)), pa.array([len(p) for p in part], pa.int64()),
                     pa.array([_narrow(p) for p in part], pa.binary())], names=["doc_id", "key", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, key long, n long, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id when all fit, else four; the length tells which."""
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 65536 else ids.tobytes()


def _wide(raw, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


class Packer:
    """Cuts one partition's stream of documents into sequences."""

    def __init__(self, partition: int, size: int):
        self.size, self.next = size, partition << 40
        self.open, self.fill, self.rows = [], 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.size - self.fill, len(ids) - at)
            self.open.append((doc, at, ids[at:at + take], len(ids)))
            at, self.fill = at + take, self.fill + take
            if self.fill == self.size:
                self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, at, ids, n in pieces:
            self.rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset, ids))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """The open rest, as sequences of power-of-two length."""
        rest, self.open = self.open, []
        while self.fill:
            room, own = 1 << (self.fill.bit_length() - 1), []
            self.fill -= room
            while room:
                doc, at, ids, n = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, at + room, ids[room:], n))
                    ids = ids[:room]
                own.append((doc, at, ids, n))
                room -= len(ids)
            self._close(own)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = 2048, vocabulary: str | None = None, ranks: str | None = None,
         tokens_per_partition: int = 8_000_000, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, in sequences of ``size`` tokens or a power of two.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``with_ids``, the piece's ids (array<int>).  Give ``ranks`` only with a
    vocabulary it is known to equal; by default both name one public vocabulary.
    """
    if vocabulary is None:
        vocabulary, ranks = public_file("byte_bpe_50k.json"), public_file("byte_bpe_50k.tiktoken")
    t = common.materialize(tokenise(docs, vocabulary, ranks), "tokens")
    total = t.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = total // tokens_per_partition + 1
    ordered = (t.repartitionByRange(parts, "key", "doc_id", "n")
               .sortWithinPartitions("key", "doc_id", "n", F.crc32("ids")))

    def run(batches):
        p = Packer(TaskContext.get().partitionId(), size)
        for batch in batches:
            for doc, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                p.add(doc, _wide(raw.as_buffer(), n))
                if len(p.rows) >= 20_000:
                    yield _table(p.rows, with_ids)
                    p.rows = []
        p.finish()
        yield _table(p.rows, with_ids)

    return ordered.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def _table(rows: list, with_ids: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
    if with_ids:
        cols.append(pa.array([r[7].astype(np.int32) for r in rows], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(cols, names=names)


def op4_curve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
