"""Registered queries against their SQL, and the pipeline against brute force."""

import duckdb
import pytest

import corpus_pipeline as P
from cohortlens.llm import common
from cohortlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_models import brute_counts, rebuilt
from tests.llm.test_text import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    cols = sorted(want.column_names)
    assert cols == sorted(got.column_names)

    def rows(t):
        return sorted((tuple(r[c] for c in cols) for r in t.to_pylist()), key=repr)

    assert rows(got) == rows(want)


def test_pipeline_stages_equal_brute_force(spark):
    docs = common.documents(spark, SF)
    quality, lines, near, mixed, _ = [f for _, f in P.STAGES]
    kept = common.materialize(quality(spark, docs, SF), "t")
    label = {r["doc_id"]: r["quality"] for r in common.labels(spark, SF).collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    good = [i for i, q in label.items() if q == 1]
    assert kept.columns == docs.columns and sum(i in ids for i in good) >= 0.97 * len(good)
    after = common.materialize(lines(spark, kept, SF), "t")
    rows = {r["doc_id"]: r["text"] for r in after.collect()}
    assert after.columns == docs.columns and rows == brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()])
    one = common.materialize(near(spark, after, SF), "t")
    want = brute_components(list(rows.items()), 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in want.items() if c == i}
    mix = common.materialize(mixed(spark, one, SF), "t")
    counts = brute_counts([(r["doc_id"], r["source"]) for r in one.collect()])
    got = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert mix.columns == docs.columns and got == {i: c for i, c in counts.items() if c}
    pieces = P.run(spark, SF).collect()
    by = rebuilt(pieces)
    assert {i: sum(p["length"] for p in ps) // ps[0]["doc_tokens"] for i, ps in by.items()} == got


def test_every_number_is_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
