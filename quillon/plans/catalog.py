"""All queries of the engine, and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, loaders, members, physics, relational  # noqa: F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["flagship"](spark, sf_dir)
