"""Local stand-in for the driver's correctness gate.

Runs ``queries()[k]`` in Spark and ``oracle_sql()[k]`` in DuckDB on the same
parquet tables and compares row count, column names and an order-insensitive
multiset of rows (floats compared exactly, as a value hash would).

Usage: python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from cohortlens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _kind(dtype: str) -> str:
    """Coarse type class as a value hash would see it (width matters for ints)."""
    d = dtype.lower()
    if d.startswith("int") or d.startswith("uint"):
        return d.replace("u", "")
    if d.startswith("float"):
        return "float"
    if d in ("bool", "boolean"):
        return "bool"
    return "object"


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, key, fn, sql, sf_dir, con):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return {"key": key, "rows": len(sp), "status": "rows-only", "sec": round(t1 - t0, 2)}
    dk = con.execute(sql).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    status = "ok"
    detail = ""
    st = {c: str(sp[c].dtype) for c in sp.columns}
    dt = {c: str(dk[c].dtype) for c in dk.columns}
    if sc != dc:
        status, detail = "schema", f"spark={sc} duck={dc}"
    elif len(sp) and len(dk) and {c: _kind(st[c]) for c in st} != {c: _kind(dt[c]) for c in dt}:
        status, detail = "types", f"spark={st} duck={dt}"
    elif len(sr) != len(dr):
        status, detail = "rowcount", f"spark={len(sr)} duck={len(dr)}"
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        status, detail = "values", f"{len(bad)} differ; first: {bad[:2]}"
    return {"key": key, "rows": len(sp), "status": status, "detail": detail, "sec": round(t1 - t0, 2)}


def main():
    from cohortlens.session import get_session
    import __spark_entry__ as E
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or sorted(qs)):
        try:
            res = compare(spark, k, qs[k], ors.get(k), sf_dir, con)
        except Exception as e:  # report and continue
            res = {"key": k, "status": "error", "detail": repr(e)[:400]}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{bad} failing of {len(keys or qs)}")


if __name__ == "__main__":
    main()
