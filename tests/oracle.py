"""Compares a query's rows with the rows of its SQL in DuckDB, in any order."""

import datetime
import decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


def same_rows(df, sql, folder):
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    names, cols = [d[0] for d in found.description], sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == want
