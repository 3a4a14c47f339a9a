"""Where the query modules register their queries, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def session_query(name: str, sql: str):
    """Registers a query that takes the session and the folder itself, as streams do."""
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(lambda t: read_table(spark, d, t))
        if sql:
            SQL[name] = sql
        return f

    return add
