"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name; ``oracle``: SQL that must give the same rows."""

    def wrap(f):
        QUERIES[name] = lambda spark, directory: f(Tables(spark, directory))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return wrap
