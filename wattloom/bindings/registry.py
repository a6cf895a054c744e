"""Collects the named queries of the binding modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, tidy, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, uses: str = "", digits: int | dict[str, int] = 4):
    """Register `fn(tables)` under a key, with its SQL over the views named in `uses`."""

    def add(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"two queries called {key!r}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(Tables(spark, folder)), digits)

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_views(tuple(uses.split()), sql)
        return fn

    return add


def load_all() -> None:
    from . import q_columns, q_facts, q_files, q_impute, q_network, q_quality, q_results, q_rollup, q_series, q_spatial  # noqa: F401
