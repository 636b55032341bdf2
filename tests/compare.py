"""Spark's rows against DuckDB's, whatever their order."""

import os

import duckdb


def duck(sql, sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    out = db.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def assert_same(df, sql, sf):
    names, rows = duck(sql, sf)
    order = sorted(names)
    assert sorted(df.columns) == order
    ours = sorted([plain(r[c]) for c in order] for r in df.collect())
    theirs = sorted([plain(r[names.index(c)]) for c in order] for r in rows)
    assert len(ours) == len(theirs)
    assert ours == theirs
