"""Registry of queries and their SQL twins.

``@query(name, "views...", sql)`` registers a Spark function ``(spark, sf_dir) -> DataFrame``.
The SQL twin is the body given, prefixed with the named views in dependency order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridmark.workload.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, tuple[str, str]] = {}


def query(name: str, views: str = "", sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            _TWINS[name] = (views, sql)
        return fn
    return register


def sql_twins() -> dict[str, str]:
    """The SQL of every query that has a twin, views included."""
    return {name: with_views(views, body) for name, (views, body) in _TWINS.items()}
