"""Registry of named queries: a Spark builder plus, where SQL can say the
same thing, a DuckDB oracle statement over the driver's views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sql_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    operators: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, views: list[str] | None = None, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``operators`` lists the SURVEY ids exercised.  ``sql`` (with ``views``
    CTEs prepended) is the oracle; omit it for the rows-only check.
    """
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        full = with_views(views or [], sql) if sql is not None else None
        QUERIES[name] = Query(name, fn, full, tuple(operators.split()))
        return fn
    return deco
