"""Where the queries and their SQL forms are put."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FORMS: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        FORMS[name] = sql


def quoted(pattern: str) -> str:
    """A pattern of the extractors as a literal of SQL, whose expressions have ASCII classes only."""
    return "'" + pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"
