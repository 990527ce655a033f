"""Grouped and whole-table aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import numeric_columns
from .ordering import missing


def aggregate(name: str, column: str, order_by: list[str] | None = None) -> Column:
    """One aggregate: count, sum, mean, median, min, max, std, var, first, last, nunique (null counts as a value)."""
    c = F.col(column)
    key = F.struct(*order_by) if order_by else None
    if name in ("first", "last") and key is None:
        raise ValueError("first and last need order_by")
    made = {
        "count": lambda: F.count(c),
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "mean": lambda: F.avg(c),
        "median": lambda: F.median(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "first": lambda: F.min_by(c, key),
        "last": lambda: F.max_by(c, key),
        "nunique": lambda: F.count_distinct(c) + F.max(c.isNull().cast("bigint")),
    }
    if name not in made:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(made)}")
    return made[name]()


def _specs(df: DataFrame, aggs: list[tuple], order_by: list[str] | None) -> list[Column]:
    missing(df, [a[0] for a in aggs])
    return [aggregate(a[1], a[0], order_by).alias(a[2] if len(a) > 2 else f"{a[0]}_{a[1]}") for a in aggs]


def group_by(df: DataFrame, by: list[str], aggs: list[tuple], order_by: list[str] | None = None) -> DataFrame:
    """``aggs``: (column, aggregate) or (column, aggregate, name)."""
    missing(df, by)
    return df.groupBy(*by).agg(*_specs(df, aggs, order_by))


def summarize(df: DataFrame, aggs: list[tuple], order_by: list[str] | None = None) -> DataFrame:
    return df.agg(*_specs(df, aggs, order_by))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    missing(df, [column])
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(column))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``<c>_count``, ``_mean``, ``_std``, ``_min``, ``_max`` of the numeric columns."""
    out = []
    for c in columns or numeric_columns(df):
        out += [F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    return df.agg(*out)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Rows (a, b, correlation) of all pairs, each over the rows where both are there; Spearman on average ranks."""
    names = columns or numeric_columns(df)
    if method == "spearman":
        from .ranks import average_ranks

        for c in names:
            df = average_ranks(df, c, c)
    pairs = [(a, b) for a in names for b in names]
    cols = [F.when(F.lit(a == b), F.lit(1.0)).otherwise(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*cols)
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.inline(rows))


def grouping_sets(df: DataFrame, by: list[str], aggs: list[tuple], kind: str = "cube") -> DataFrame:
    """Cube or rollup over the keys."""
    return getattr(df, kind)(*by).agg(*_specs(df, aggs, None))
