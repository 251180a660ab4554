"""Named queries over the test tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardgrid.fixtures import fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


class Inputs:
    """Attribute access to the tables and views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            CHECK_SQL[name] = with_views(sql)
        return fn

    return register


def r(expr: str, digits: int = 6) -> str:
    """Check-SQL rounding that matches ``rounded``; adding zero removes a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
