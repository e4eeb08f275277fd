"""Registration of queries with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """A module's queries, their SQL, and the decorator that adds to both."""
    queries: dict[str, Query] = {}
    statements: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return add

    return queries, statements, query
