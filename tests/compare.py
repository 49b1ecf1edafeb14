"""Rows of a query against rows of its SQL, without regard to their order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    return v


def same_rows(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
