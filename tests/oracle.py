"""Holds a DataFrame against DuckDB's rows for the same tables."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        f = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f + '/*.parquet' if os.path.isdir(f) else f}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, folder: str) -> None:
    got = rows_of(df.columns, df.collect())
    con = connect(folder)
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, answer.fetchall())
    assert len(got) == len(want)
    assert got == want
