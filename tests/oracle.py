"""Comparison of a query's rows with those of its SQL in DuckDB."""

import datetime as dt
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((repr([plain(r[c]) for c in names]) for r in df.collect()))


def rows_of_sql(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
