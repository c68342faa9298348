"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted over whole texts.  For each word every string one deletion
away, and every string with one letter replaced by a letter later in the
alphabet, is generated as a hash (a polynomial over letters, so an edit is one
multiplication) and probed against Bloom filters of the vocabulary: one filter a
word length (a deletion asks the filter of its own shorter length), made of
64-bit blocks, so a probe reads one machine word.  Only strings that the filters
pass are written out; an equi-join with the vocabulary keeps the real words.
Being one edit apart is symmetric, so insertions and replacements by earlier
letters are the same pairs seen from the other word: no pair is lost.

Filters sent to tasks hold at most ``max_bytes``; a larger vocabulary is probed
in several passes, each with the filters of one slice of the hashes, so neither
the broadcast nor the share of false positives grows with the corpus.  A word has
at most length times alphabet neighbours, so no key of the join is hot.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty
text in the hash of its runs; repeated rows count each; ties of the largest count
go to the word first in code-point order; very long runs are words like others;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common

RUN = "[A-Za-zÀ-ÿ]+"
BITS_PER_WORD = 20
BITS_SET = 4
MAX_BYTES = 32 << 20
CELLS = 1 << 20
U = np.uint64
_B = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_B_INVERSE = U(pow(_B, -1, 1 << 64))


def letter_hash(code: np.ndarray) -> np.ndarray:
    return common.mix64(code.astype(np.uint64) + U(0x1234567))


def powers(n: int) -> np.ndarray:
    """B^(n-1) .. B^0 modulo 2^64."""
    out = np.full(n, U(1))
    if n > 1:
        out[1:] = U(_B)
        out = np.cumprod(out, dtype=np.uint64)
    return out[::-1]


def by_length(words: list[str]):
    """(indices, code-point matrix) of the words of each length."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        step = max(1, CELLS // max(1, n))
        for a in range(0, len(rows), step):
            part = rows[a:a + step]
            codes = np.frombuffer("".join(words[i] for i in part.tolist()).encode("utf-32-le"), dtype="<u4")
            yield part, codes.reshape(len(part), n)


def word_hash(codes: np.ndarray) -> np.ndarray:
    return (letter_hash(codes) * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


class Filters:
    """Blocked Bloom filters of one slice of the vocabulary, one a word length, in one array."""

    def __init__(self, counts: dict, passes: int, part: int):
        self.passes, self.part, self.at, total = passes, part, {}, 0
        for n, c in sorted(counts.items()):
            blocks = 1
            while blocks * 64 * passes < BITS_PER_WORD * c:
                blocks *= 2
            self.at[n] = (total, blocks)
            total += blocks
        self.words = np.zeros(total, dtype=np.uint64)

    def place(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether in this slice, block, bits) of hashes of strings of n letters."""
        h = common.mix64(h ^ U(n))
        begin, blocks = self.at[n]
        mask = np.zeros(h.shape, dtype=np.uint64)
        for j in range(BITS_SET):
            mask |= U(1) << (h >> U(6 * j) & U(63))
        own = (h >> U(56)) % U(self.passes) == U(self.part)  # passes stay below 256
        return own, begin + (h >> U(24) & U(blocks - 1)).astype(np.int64), mask

    def passed(self, h: np.ndarray, n: int) -> np.ndarray:
        if n not in self.at:
            return np.zeros(h.shape, dtype=bool)
        own, block, mask = self.place(h, n)
        return own & (self.words[block] & mask == mask)

    def fill(self, vocabulary: DataFrame) -> "Filters":
        """Bits of all words, united by block in Spark; what arrives is no larger than the filters."""
        empty = self

        def bits(batches):
            for batch in batches:
                words = batch.column(0).to_pylist()
                for _, codes in by_length(words):
                    own, block, mask = empty.place(word_hash(codes), codes.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(block[own]), pa.array(mask[own].view(np.int64))],
                                                     names=["block", "mask"])

        found = (vocabulary.select("word").mapInArrow(bits, "block long, mask long")
                 .groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow())
        self.words[found.column("block").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        return self


def edits(words: list[str], alphabet: np.ndarray, filters: Filters):
    """(word index, neighbour) of generated edits that the filters pass."""
    letters = letter_hash(alphabet)
    for rows, codes in by_length(words):
        n = codes.shape[1]
        own, power = letter_hash(codes), powers(n)
        terms = own * power
        h = terms.sum(axis=1, dtype=np.uint64)
        if n:
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            shorter = before * _B_INVERSE + (h[:, None] - before - terms)
            hit = filters.passed(shorter, n - 1)
            hit[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # the same string again
            for r, i in zip(*(x.tolist() for x in np.nonzero(hit))):
                w = words[rows[r]]
                yield rows[r], w[:i] + w[i + 1:]
        for a, la in zip(alphabet.tolist(), letters):
            hit = (codes < a) & filters.passed(h[:, None] + (la - own) * power, n)
            for r, i in zip(*(x.tolist() for x in np.nonzero(hit))):
                w = words[rows[r]]
                yield rows[r], w[:i] + chr(a) + w[i + 1:]


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): runs of letters, lower-cased in A-Z, with the rule's deletions, that are long and frequent enough."""
    run = F.explode(F.regexp_extract_all(common.ascii_lower(F.col("text")), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), run.alias("w"))
    runs = runs.where(F.length("w") >= least_length)
    h = F.crc32(F.concat("i", F.lit(":"), "w").cast("binary"))
    at = F.pmod(F.col("h"), F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("w")).alias("word"))
    return (words.where(F.length("word") >= least_length).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def neighbours(vocabulary: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(word, n, other, other_n): all pairs one edit apart, each once, over a written table (word, n)."""
    sizes = {r["len"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("len"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word length
    symbols = np.array(sorted(ord(r["c"]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c"))
                              .where("c <> ''").distinct().collect()), dtype=np.int64)  # the alphabet
    passes = max(1, math.ceil(sum(sizes.values()) * BITS_PER_WORD / 4 / max_bytes))
    if passes > 255:
        raise ValueError("raise max_bytes: over 255 slices of the vocabulary")
    pairs = None
    for part in range(passes):
        filters = Filters(sizes, passes, part).fill(vocabulary)

        def probe(batches, filters=filters):
            for batch in batches:
                words = batch.column(0).to_pylist()
                found = list(edits(words, symbols, filters))
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at),
                                                  pa.array([w for _, w in found], pa.string())],
                                                 names=["word", "n", "other"])

        # words are dealt evenly: a probe costs far more than its row
        hits = vocabulary.select("word", "n").repartition("word").mapInArrow(probe, "word string, n long, other string")
        pairs = hits if pairs is None else pairs.unionByName(hits)
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.join(exact, "other").select("word", "n", "other", "other_n")


def variants(vocabulary: DataFrame, factor: int = 5, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the table (word, n)."""
    vocabulary = common.materialize(vocabulary.select("word", "n"), "vocabulary")
    pairs = common.materialize(neighbours(vocabulary, max_bytes), "neighbours")
    turned = pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = (pairs.select("word", "other", "other_n").unionByName(turned).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("top")))
    enough = -F.col("top.m") >= factor * F.col("n")
    words = common.materialize(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("top.other")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n")), "forms")
    # each step multiplies n by the factor at least, so chains are short; every round doubles the steps followed
    roots = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 1
    while steps < math.log(most, factor):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = common.materialize(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(common.documents(spark, sf_dir)))
