"""Language identification by nearest centroid over TF-IDF byte n-grams.

A text is lower-cased; its UTF-8 byte n-grams (1 to 4, to the last byte) are
hashed into ``dims`` columns, damped as ``1 + ln(tf)``, weighted by inverse
document frequency and normalised.  Document frequencies count every training
text.  Each language gets ``clusters`` centroids by spherical k-means over a
bounded sample (``per_lang`` different texts, the first by a hash of the text),
one task per language on at most ``per_lang`` rows of ``dims`` floats.  The
prediction is the language of the nearest centroid by cosine, which is the
score; a text farther from it than nearly all (``reject_share``) of the sample
of that cluster is flagged ``rejected``.

The model holds languages x clusters x dims floats, in a written table.  Texts are
compared with at most ``block_bytes`` of centroids at a time; more languages take
more passes, each keeping a text's best so far, so any number of them is learned
and what is sent to tasks stays bounded.  The sample takes texts of at most ``max_chars``
characters; a language that has only longer ones is learned from their first
``max_chars`` characters.

Edge cases: null, empty and letterless texts give ``und`` with score 0 and are
rejected; training rows with null language or without letters are ignored;
without training rows everything is ``und``; ties go to the alphabetically first
language; repeated rows are each predicted; extra columns pass through, ones named
lang_pred, score or rejected are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import common

LETTER = regex.compile(r"\p{L}")
GRAMS = (1, 2, 3, 4)
BATCH_BYTES = 4_000_000


def _groups(texts: list) -> list:
    """(from, to) slices of about BATCH_BYTES characters, at least one text each."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > BATCH_BYTES or i - start >= 512):
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    return out + [(start, len(texts))] if texts else []


def gram_counts(texts: list, dims: int) -> np.ndarray:
    """n x dims counts of the hashed n-grams of lower-cased texts."""
    raw = [t.lower().encode() for t in texts]
    n = np.array([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * dims, n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(data))  # bytes from here to the end of the text
    out = np.zeros(len(texts) * dims, dtype=np.int64)
    h = np.zeros(len(data), dtype=np.uint32)
    for g in range(1, max(GRAMS) + 1):
        if len(data) < g:
            break
        h = h[:len(data) - g + 1] * np.uint32(0x01000193) + data[g - 1:] + np.uint32(1)
        ok = left[:len(h)] >= g
        x = (h ^ np.uint32(g * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(15))) % np.uint32(dims)
        out += np.bincount((row[:len(h)] + x)[ok], minlength=len(out))
    return out.reshape(len(texts), dims)


def _weighted(texts: list, idf: np.ndarray) -> np.ndarray:
    tf = gram_counts(texts, len(idf))
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _has_letter(t) -> bool:
    return t is not None and LETTER.search(t) is not None


class Model:
    """idf, centroids (k x dims), their languages and rejection radii."""

    def __init__(self, idf, centroids, langs, radii):
        self.idf, self.centroids, self.langs, self.radii = idf, centroids, langs, radii

    def predict(self, texts: list) -> tuple[list, list, list]:
        lang, score, far = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.langs:
            return lang, score, far
        known = [i for i, t in enumerate(texts) if _has_letter(t)]
        for a, b in _groups([texts[i] for i in known]):
            cos = _weighted([texts[i] for i in known[a:b]], self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            for i, k, c in zip(known[a:b], best.tolist(), cos[np.arange(b - a), best].tolist()):
                lang[i], score[i], far[i] = self.langs[k], min(1.0, max(0.0, c)), bool(c < self.radii[k])
        return lang, score, far


class Table:
    """All centroids as a table (block, lang, k, centroid, radius), with the idf they use."""

    def __init__(self, idf, rows: DataFrame | None, blocks: int):
        self.idf, self.rows, self.blocks = idf, rows, blocks

    @property
    def langs(self) -> list[str]:
        """The languages learned."""
        return [] if self.rows is None else [r["lang"] for r in self.rows.select("lang").distinct().orderBy("lang").collect()]

    def block(self, number: int) -> Model:
        """One block of centroids, in order of language."""
        got = [] if self.rows is None else self.rows.where(F.col("block") == number).orderBy("lang", "k").collect()
        return Model(self.idf, np.array([np.frombuffer(r["centroid"], "<f4") for r in got]).reshape(-1, len(self.idf)),
                     [r["lang"] for r in got], [r["radius"] for r in got])


def document_frequency(train: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Texts holding each hashed n-gram, over all of ``train``; dims numbers reach the driver."""

    def run(batches):
        df, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if _has_letter(t)]
            for a, b in _groups(texts):
                df += (gram_counts(texts[a:b], dims) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], df]))],
                                         names=["gram", "n"])

    rows = (train.select("text").mapInArrow(run, "gram long, n long").groupBy("gram")
            .agg(F.sum("n").alias("n")).collect())
    df = np.zeros(dims, dtype=np.int64)
    n = 0
    for r in rows:
        if r["gram"] < 0:
            n = r["n"]
        else:
            df[r["gram"]] = r["n"]
    return df, n


def _centroids(texts: list, idf: np.ndarray, clusters: int, reject_share: float, rounds: int = 12):
    """Spherical k-means from farthest-first starts; (centroid, radius) list."""
    v = _weighted(texts, idf)
    c = v.mean(axis=0, keepdims=True)
    picks, near = [], v @ (c[0] / (np.linalg.norm(c[0]) or 1))
    for _ in range(min(clusters, len(v))):
        picks.append(int(near.argmin()) if picks else int(near.argmax()))
        near = np.maximum(near, v @ v[picks[-1]]) if len(picks) > 1 else v @ v[picks[-1]]
    c = v[picks]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cos = v @ c.T
    own = cos.argmax(axis=1)
    return [(c[k], float(np.quantile(cos[own == k, k], reject_share))) for k in range(len(c)) if (own == k).any()]


def fit(train: DataFrame, dims: int = 4096, clusters: int = 4, per_lang: int = 800,
        max_chars: int = 20_000, reject_share: float = 0.01, block_bytes: int = 64 << 20) -> Table:
    """Learns from (text, lang) rows; bounds as stated in the module text."""
    t = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    langs = common.materialize(t.groupBy("lang").agg(F.min(F.length("text")).alias("shortest")), "langs")
    if not langs.take(1):
        return Table(np.zeros(dims, np.float32), None, 1)
    df, n = document_frequency(t, dims)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    short = t.where(F.length("text") <= max_chars)
    if langs.where(F.col("shortest") > max_chars).take(1):
        long_only = langs.where(F.col("shortest") > max_chars).select("lang")
        short = short.unionByName(t.where(F.length("text") > max_chars).join(long_only, "lang", "left_semi")
                                  .select("lang", F.substring("text", 1, max_chars).alias("text")))
    short = short.withColumn("h", F.xxhash64("text"))
    keys = short.select("lang", "h").distinct()
    # two ranks, each pruned in every partition before its shuffle: the first splits a language in 64
    # parts, so the second reads at most 64 * per_lang rows of it, however many partitions there are
    for part in (F.pmod("h", F.lit(64)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("lang", part).orderBy("h"))
        keys = keys.withColumn("r", rank).where(F.col("r") <= per_lang).select("lang", "h")
    # a written table: its size is known, so the join broadcasts it exactly below Spark's threshold
    first = common.materialize(keys, "sample")
    sample = short.join(first, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "text"])
        found = _centroids(pdf["text"].tolist(), idf, clusters, reject_share)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(found)),
                             "centroid": [c.astype("<f4").tobytes() for c, _ in found],
                             "radius": [r for _, r in found]})

    rows = common.materialize(sample.groupBy("lang").applyInPandas(
        run, "lang string, k int, centroid binary, radius double"), "centroids")
    blocks = max(1, -(-rows.count() * 4 * dims // block_bytes))
    return Table(idf, rows.withColumn("block", F.pmod(F.xxhash64("lang", "k"), F.lit(blocks)).cast("int")), blocks)


def identify(docs: DataFrame, model: Table | Model) -> DataFrame:
    """All rows and columns of ``docs`` plus ``lang_pred``, ``score``, ``rejected``."""
    docs = docs.drop(*("lang_pred", "score", "rejected"))
    names, at = docs.columns, docs.columns.index("text")
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *more])
    blocks = model.blocks if isinstance(model, Table) else 1
    out = docs
    for number in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(model.block(number) if isinstance(model, Table) else model)

        def run(batches, shared=shared, first=number == 0):
            for batch in batches:
                lang, score, far = shared.value.predict(batch.column(at).to_pylist())
                if not first:
                    old = [batch.column(len(names) + i).to_pylist() for i in range(3)]
                    for i, (o, s) in enumerate(zip(old[0], old[1])):
                        # the block before keeps what it found nearer, or as near and earlier in the alphabet
                        if lang[i] == "und" or (o != "und" and (s, lang[i]) > (score[i], o)):
                            lang[i], score[i], far[i] = o, s, old[2][i]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(far, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

        out = out.mapInArrow(run, schema)
        if number + 1 < blocks:
            out = common.materialize(out, "identified")  # one block of centroids in a task at a time
    return out


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = F.pmod(common.id_crc(F.col("doc_id")), F.lit(3)) == 1
    model = fit(docs.where(~held).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
