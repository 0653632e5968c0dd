"""Queries over the driver's tables, and the SQL that states their results.

A query is a function (spark, sf_dir) -> DataFrame here, registered with its SQL text, or without one where SQL has no
words for it (grammar, trees, folds); such queries are held against literal cases in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from leafmill.plans import folds, growth, people, reading, relational, scalars, sheets, shelf, speech  # noqa: F401  they register on import


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["x7_page_blocks"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
