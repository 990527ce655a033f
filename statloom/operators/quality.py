"""Data quality: one wide aggregate for the profile, a second pass for outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import numeric_columns


def profile(df: DataFrame) -> DataFrame:
    """A row per column: type, rows, nulls, distinct values, and for numbers min, max, mean, std and quartiles."""
    numbers = set(numeric_columns(df))
    cols = []
    for i, (c, _) in enumerate(df.dtypes):
        cols += [F.count("*").alias(f"n{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.count_distinct(c).alias(f"d{i}")]
        if c in numbers:
            x = F.col(c).cast("double")
            cols += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.percentile(x, [0.25, 0.5, 0.75]).alias(f"q{i}")]
    wide = df.agg(*cols)
    null = F.lit(None).cast("double")
    rows = []
    for i, (c, k) in enumerate(df.dtypes):
        num = c in numbers
        get = lambda p, i=i, num=num: F.col(f"{p}{i}") if num else null
        q = [F.col(f"q{i}")[j] if num else null for j in range(3)]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(k).alias("dtype"), F.col(f"n{i}").alias("n_rows"), F.col(f"z{i}").alias("n_null"), F.col(f"d{i}").alias("n_distinct"), get("lo").alias("min"), get("hi").alias("max"), get("m").alias("mean"), get("s").alias("std"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75")))
    return wide.select(F.inline(F.array(*rows)))


def outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Numbers below q25 - k*IQR and above q75 + k*IQR, and the two fences."""
    x = F.col(column).cast("double")
    q = df.agg(F.percentile(x, [0.25, 0.75])).first()[0] or [0.0, 0.0]
    low, high = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
    return df.agg(F.count_if(x < low).alias("n_low"), F.count_if(x > high).alias("n_high")).select(F.lit(column).alias("column"), F.lit(low).alias("low_fence"), F.lit(high).alias("high_fence"), "n_low", "n_high")


def issues(df: DataFrame, null_share: float = 0.05) -> DataFrame:
    """Columns with many nulls, one value only, or a distinct value in every row."""
    p = profile(df)
    kind = F.when(F.col("n_null") > F.col("n_rows") * null_share, "many_nulls").when(F.col("n_distinct") <= 1, "constant").when(F.col("n_distinct") == F.col("n_rows"), "unique")
    return p.select("column", kind.alias("issue")).where("issue is not null")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a cleaning step changed: rows and nulls per column before and after."""
    a, b = profile(before), profile(after)
    a = a.select("column", F.col("n_rows").alias("rows_before"), F.col("n_null").alias("nulls_before"))
    b = b.select("column", F.col("n_rows").alias("rows_after"), F.col("n_null").alias("nulls_after"))
    return a.join(b, "column", "full")
