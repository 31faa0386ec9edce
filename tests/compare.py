"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        name = f.removesuffix(".parquet")
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted(columns), rows_of(columns, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())
