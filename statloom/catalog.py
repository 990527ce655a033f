"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis, more, munging  # noqa: F401  (more registers its queries with those of analysis)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return munging.QUERIES["slice_revenue"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return munging.QUERIES | analysis.QUERIES


def oracle_sql() -> dict[str, str]:
    return munging.SQL | analysis.SQL
