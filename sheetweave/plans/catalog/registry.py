"""Registration of queries with the SQL that yields the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.sources.fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The SQL over the drawing tables alone, for tests on other drawings.
SOURCE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Fixtures(spark, folder))
        if sql is not None:
            SOURCE[name] = sql
            ORACLE[name] = oracle(sql)
        return plan
    return register


def r6(value: Column | str) -> Column:
    """Doubles are compared after rounding to six places."""
    return F.round(value, 6)


def named(**columns: Column) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def box_columns(b) -> list[Column]:
    return [c.alias(name) for c, name in zip(b, ("x1", "y1", "x2", "y2"))]
