"""Registered queries against their SQL in DuckDB."""

import glob
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(spark, query, folder):
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    found = con.sql(sql)
    names = list(found.columns)
    columns = sorted(names)
    return columns, sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in found.fetchall())
