"""Ranks without a single-partition window: counts per value, ranged prefix sums over the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import PART, missing, ranged


def value_ranks(df: DataFrame, column: str, weight: str | None = None, *carried: str) -> DataFrame:
    """A row per distinct non-null value: n, below (rows of smaller values), dense (place among the values from 1) and sums of carried columns.

    With a weight, a row counts that many times.
    """
    missing(df, [column])
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.sum(weight) if weight else F.count("*")).alias("n"), *(F.sum(c).alias(c) for c in carried))
    rows = ranged(counts, [column])
    totals = rows.groupBy(PART).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
    side = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select(PART, F.coalesce(F.sum("t").over(side), F.lit(0)).alias("__t"), F.coalesce(F.sum("d").over(side), F.lit(0)).alias("__d"))
    w = Window.partitionBy(PART).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(totals), PART)
    return rows.select(column, "n", (F.col("__t") + F.sum("n").over(w) - F.col("n")).alias("below"), (F.col("__d") + F.count("*").over(w)).alias("dense"), *carried)


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the average rank of each value (null for null)."""
    ranks = value_ranks(df, column).select(F.col(column).alias("__k"), (F.col("below") + (F.col("n") + 1) / 2).alias("__rank"))
    out = df.join(ranks, df[column] == F.col("__k"), "left").drop("__k")
    return out.select(*(c for c in df.columns if c != name), F.col("__rank").alias(name))


def rank(df: DataFrame, column: str, descending: bool = False, name: str | None = None) -> DataFrame:
    """``df`` with the dense rank of each value (null for null)."""
    ranks = value_ranks(df, column)
    dense = F.col("dense")
    if descending:
        dense = F.lit(ranks.agg(F.max("dense")).first()[0] or 0) + 1 - dense
    ranks = ranks.select(F.col(column).alias("__k"), dense.alias("__rank"))
    out = df.join(ranks, df[column] == F.col("__k"), "left").drop("__k")
    return out.select(*df.columns, F.col("__rank").alias(name or f"{column}_rank"))
