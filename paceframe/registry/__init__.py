"""Every operator as a query over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Named queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query; without SQL only its own tests check the values."""

        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return register


CATALOGUE = Catalogue()


def load_all() -> Catalogue:
    """Import every module that registers queries."""
    from paceframe.registry import aggregates, columns, jobs, joins, streams, tables, windows  # noqa: F401

    return CATALOGUE
