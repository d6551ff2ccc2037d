"""A register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function of (spark, sf_dir); sql is its DuckDB form, with views in braces."""

        def add(function: Query) -> Query:
            self.queries[name] = function
            if sql:
                self.sql[name] = sql
            return function

        return add
