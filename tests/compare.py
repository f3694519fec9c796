"""Rows of a query beside those of its oracle SQL, columns by name, in any order."""

import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def both(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    res = connect(sf).execute(sql)
    columns = [c[0] for c in res.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = [tuple(r[k] for k in at) for r in res.fetchall()]
    return sorted(map(repr, got)), sorted(map(repr, want))
