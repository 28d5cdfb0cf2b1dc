"""Runs a query and its SQL over the same tables."""

import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if isinstance(v, (int, type(None))) else str(v)


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = query(spark, sf)
    got = con.execute(sql)
    cols, rows = [x[0] for x in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(cols)
    key = sorted(cols)
    ours = sorted((repr([plain(r[k]) for k in key]) for r in df.collect()))
    theirs = sorted((repr([plain(r[cols.index(k)]) for k in key]) for r in rows))
    assert ours == theirs
