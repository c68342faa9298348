import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text[, lang, source]) rows to a documents table, with extra columns if asked for."""

    def make(rows, **extra):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F
        return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df

    return make


#: Names that the operators use themselves.
CLASH = {c: 1 for c in ("h", "_h", "_id", "k", "key", "keys", "rep", "rid", "row", "m", "d", "r", "u", "n", "label",
                        "score", "rejected", "lang_pred", "copies", "copy", "shuffle_key", "n_lines", "n_removed",
                        "covered", "pos", "lines", "marks", "ids", "base", "tokens", "component_id", "kept", "f1")}


@pytest.fixture(scope="session")
def clash():
    return CLASH


@pytest.fixture(scope="session")
def edge(frame):
    """Nulls, empty, blank, very long and repeated rows."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, long), (4, long), (5, "one"), (6, "one two"),
            (None, "a null id and a text"), (7, "Ünï cödé 漢字 \U0001f600 text"), (7, "other text under the same id"),
            (8, "l1\nl2\nl3\nl4\nl1\nl2\nl3"), (9, "l1\nl2\nl3")]
    return frame(rows)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
