"""A query's rows beside those of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb


def normal(v) -> str:
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return str(v)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def both(con, df, sql: str) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = lambda got: sorted("|".join(normal(v) for v in r) for r in got)
    return rows([r[c] for c in columns] for r in df.collect()), rows([r[i] for i in at] for r in want.fetchall())
