"""Named queries over the tables, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.catalog import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name, with its SQL if it has any."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def load() -> None:
    from quarry.queries import aggregates, detection, graphs, lifecycle, matching, ranking, search, streams, tables, texts  # noqa: F401
