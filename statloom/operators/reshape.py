"""Long to wide and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import numeric_columns
from .ordering import INDEX, indexed, missing

#: Distinct headers that pivot, transpose and one-hot accept: they become columns.
MAX_COLUMNS = 10_000


def distinct_values(df: DataFrame, column: str) -> list:
    """Distinct values that become columns, in order; more than ``MAX_COLUMNS`` are refused."""
    rows = df.select(column).distinct().orderBy(column).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    return [r[0] for r in rows]


def pivot(df: DataFrame, index: list[str], on: str, values: str) -> DataFrame:
    """One row per index, one column per value of ``on``; repeated cells are an error."""
    missing(df, [*index, on, values])
    heads = [v for v in distinct_values(df, on) if v is not None]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"more than one value of {values} in a cell"))).otherwise(F.first(values))
    return df.groupBy(*index).pivot(on, heads).agg(once)


def melt(df: DataFrame, id_vars: list[str], value_vars: list[str] | None = None, variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Values as doubles; null and non-numeric cells become NaN."""
    names = value_vars or [c for c in df.columns if c not in id_vars]
    missing(df, [*id_vars, *names])
    as_double = [F.coalesce(F.col(c).try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names]
    return df.select(*id_vars, *as_double).unpivot(id_vars, names, variable_name, value_name)


def stack(df: DataFrame, columns: list[str], stacked_name: str, source_name: str) -> DataFrame:
    """The columns under each other, with the name each value comes from; all others are repeated."""
    missing(df, columns)
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, source_name, stacked_name)


def transpose(df: DataFrame, order_by: list[str], header_name: str = "column") -> DataFrame:
    """Rows become columns ``column_0``, ``column_1``, ... (at most ``MAX_COLUMNS`` rows)."""
    names = numeric_columns(df)
    rows = indexed(df.select(*names) if set(order_by) <= set(names) else df, order_by)
    n = rows.count()
    if n > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} rows")
    long = rows.select(INDEX, *(F.col(c).cast("double").alias(c) for c in names)).unpivot([INDEX], names, header_name, "value")
    wide = long.groupBy(header_name).pivot(INDEX, list(range(n))).agg(F.first("value"))
    return wide.withColumnsRenamed({str(i): f"column_{i}" for i in range(n)})


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row per list element; empty and null lists give a null row."""
    missing(df, [column])
    return df.select(*(F.explode_outer(c).alias(c) if c == column else F.col(c) for c in df.columns))
