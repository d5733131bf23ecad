"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


def rows_of(frame, columns):
    return sorted(tuple(shown(v) for v in r) for r in frame.select(*columns).collect())


def assert_same(frame, sql: str, sf: str):
    columns = sorted(frame.columns)
    result = connect(sf).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())
    assert rows_of(frame, columns) == wanted
