"""Quality classifier by compression: one zstandard dictionary per class.

Labelled texts of each class train a dictionary.  A text is cut into pieces of
``piece`` bytes; all of them, to its last byte, are compressed against either
dictionary, and ``(bad - good) / (bad + good)`` of the summed sizes says which
class the text shares more content with.  A logistic curve fitted on held-back
labelled texts turns that difference, together with the compression ratio
``(bad + good) / (2 * bytes)`` (repetition) into a score from 0 to 1.

Fitting is bounded: at most ``per_class`` different labelled texts of at most
``max_chars`` characters per class, the first by a hash of the text (so copies
count once); half of them build the dictionaries, half the curve.  Scoring covers whole texts.

Edge cases: null and empty texts score the share of good labels; rows without a
0/1 label are not learned from; without labels of both classes every text scores
that share (0.5 without any label); repeated rows are scored each; extra columns
pass through, one named score is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import common

THRESHOLD = 0.3


class Model:
    """Dictionaries, curve and prior; small (two dictionaries) and picklable."""

    def __init__(self, good: bytes, bad: bytes, curve: list, prior: float, piece: int, level: int):
        self.good, self.bad, self.curve, self.prior = good, bad, curve, prior
        self.piece, self.level = piece, level

    def compressors(self) -> list:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False,
                                                write_content_size=False, write_dict_id=False))
        return out

    def features(self, data, pair) -> list:
        """[normalised difference, compression ratio] of all pieces of a text."""
        good = bad = 0
        for i in range(0, len(data), self.piece):
            part = data[i:i + self.piece]
            good += len(pair[0].compress(part))
            bad += len(pair[1].compress(part))
        return [(bad - good) / (bad + good), (bad + good) / (2 * len(data))]

    def score(self, data, pair) -> float:
        if not len(data) or not self.curve:
            return self.prior
        d, r = self.features(data, pair)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * d + c * r))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> list:
    """Newton steps for a small logistic regression with intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, marks: DataFrame, per_class: int = 2000, max_chars: int = 20_000,
        dictionary: int = 112_640, piece: int = 2048, level: int = 3) -> Model:
    """Learns from the texts of ``docs`` that ``marks`` (doc_id, label) labels.

    The join is on ids and text hashes only; of the texts themselves no more
    than the bounded sample is moved.
    """
    marked = common.materialize(
        docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").between(1, max_chars).alias("fits"))
        .join(marks.where(F.col("label").isin(0, 1)), "doc_id").select("label", "h", "fits"), "marked")
    n = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = n.get(1, 0) / sum(n.values()) if n else 0.5
    texts = {}
    for label in (0, 1):
        keys = common.smallest_hashes(marked.where((F.col("label") == label) & F.col("fits")), per_class)
        texts[label] = [s.encode() for s in common.texts_of(docs, keys)]
    if min(len(texts[0]), len(texts[1])) < 2:
        return Model(b"", b"", [], prior, piece, level)

    def built(samples: list) -> bytes:
        parts = [s[i:i + piece] for s in samples for i in range(0, len(s), piece)]
        try:
            return zstandard.train_dictionary(dictionary, parts).as_bytes()
        except zstandard.ZstdError:  # too few samples: their text itself is a valid raw dictionary
            return b"".join(samples)[-dictionary:] + b" " * 8

    model = Model(built(texts[1][::2]), built(texts[0][::2]), [], prior, piece, level)
    pair = model.compressors()
    x, y = [], []
    for label in (0, 1):
        for s in texts[label][1::2]:
            x.append(model.features(s, pair))
            y.append(label)
    model.curve = _logistic(np.array(x), np.array(y, dtype=float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` plus ``score``."""
    docs = docs.drop(*("score",))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        pair = model.compressors() if model.curve else None
        for batch in batches:
            data, off = common.utf8(batch.column(at))
            view = memoryview(data)
            s = [model.score(view[a:b], pair) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())],
                                             names=[*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def open_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows open to learning: crc32(doc_id) mod 5 is not 0.

    A document with several labels gives one row for each.
    """
    l = labels.where((F.pmod(common.id_crc(F.col("doc_id")), F.lit(5)) != 0) & F.col("quality").isin(0, 1))
    return l.select("doc_id", F.col("quality").alias("label"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, open_labels(common.labels(spark, sf_dir)))
    out = score(docs, model)
    return out.select("doc_id", (F.pmod(common.id_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"),
                      "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
