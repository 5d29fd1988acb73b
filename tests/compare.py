"""Runs each query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return plain(v) if isinstance(v, float) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both agree, else what differs."""
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    for c in got.columns:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and {a, b} != {"i", "u"} and len(got) and got[c].notna().all() and want[c].notna().all():
            return f"type of {c}: {got[c].dtype} and {want[c].dtype}"
    a, b = rows(got), rows(want)
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(a)} and {len(b)} rows; first {[x for x in a if x not in sb][:2]} and {[x for x in b if x not in sa][:2]}"
    return None
