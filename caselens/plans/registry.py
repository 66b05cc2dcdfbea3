"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries of one module by name, and the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return put
