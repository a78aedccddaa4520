"""Queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def check(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = query(spark, DATA)
    done = con.execute(sql)
    names = [x[0] for x in done.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, done.fetchall())
