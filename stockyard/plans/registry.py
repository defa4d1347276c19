"""Named queries over the fixture views, each with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockyard.plans.sqlviews import with_views
from stockyard.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register `fn(fixtures) -> DataFrame`; `views` are extra named queries for `sql`."""

    def add(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql:
            SQL[name] = with_views(sql, views)
        return fn

    return add
