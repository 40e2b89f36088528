"""Registered queries: a callable of (spark, sf_dir), and SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Named table expressions of the SQL, each after those that it uses.
TABLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return register


def with_tables(sql: str) -> str:
    """SQL with a WITH clause of the tables that it names, directly or through others."""
    used, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in TABLES.items():
            if name not in used and any(f" {name}{end}" in f" {text} ".replace("\n", " ").replace("(", " ( ") for end in (" ", ",", ")", ";")):
                used.add(name)
                todo.append(body)
    if not used:
        return sql
    clause = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in TABLES.items() if name in used)
    if m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{clause},\n{sql[m.end():]}"
    return f"WITH {clause}\n{sql}"
