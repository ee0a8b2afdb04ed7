"""Named queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binding import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, also: str = "") -> Callable[[Query], Query]:
    """Registers a query. ``sql`` may use the tables of ``binding.CTES`` (e, p, legs), and ``also``
    adds CTEs of its own."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {CTES}{', ' + also if also else ''} {sql}"
        return f

    return register
