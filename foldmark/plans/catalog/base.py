"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' exists")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """Round every double, so that summation order does not show."""
    def col(name: str, dtype: str) -> Column:
        if dtype != "double":
            return F.col(f"`{name}`")
        return F.round(F.col(f"`{name}`"), more.get(name, digits)).alias(name)
    return df.select(*[col(n, t) for n, t in df.dtypes])


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)
