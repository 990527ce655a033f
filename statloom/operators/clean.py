"""Cleaning: missing values, duplicates, casts, clipping, replacing, strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import missing

#: Names of cast targets.
TYPES = {
    "int": "bigint", "int64": "bigint", "integer": "bigint", "int32": "int", "float": "double", "float64": "double", "double": "double", "float32": "float",
    "string": "string", "str": "string", "text": "string", "bool": "boolean", "boolean": "boolean",
}
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_EPSILON = 2.220446049250313e-16


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in _NUMERIC or k.startswith("decimal")]


def _at_end(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.select(*(c for c in df.columns if c != column), value.alias(column))


def _string(df: DataFrame, column: str) -> Column:
    missing(df, [column])
    if dict(df.dtypes)[column] != "string":
        raise TypeError(f"{column} is no string column")
    return F.col(column)


def drop_na(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with nulls in any or all of the columns; NaN is a value."""
    names = columns or df.columns
    missing(df, names)
    here = [F.col(c).isNotNull() for c in names]
    out = here[0]
    for c in here[1:]:
        out = out & c if how == "any" else out | c
    return df.where(out)


def fill_na(df: DataFrame, strategy: str, columns: list[str] | None = None, value: str | float | None = None, order_by: list[str] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """Fill nulls: constant, zero, mean, median, mode, forward or backward.

    Mean and median give doubles, 0 for columns without values. Forward and
    backward need an order; without groups they run over ranges of the order
    with the last known value of the ranges before carried on.
    """
    names = columns or (numeric_columns(df) if strategy in ("mean", "median", "zero") else df.columns)
    missing(df, names)
    kinds = dict(df.dtypes)
    if strategy in ("mean", "median"):
        f = F.avg if strategy == "mean" else F.median
        row = df.agg(*(f(F.col(c).cast("double")).alias(c) for c in names)).first()
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(row[c] or 0.0))) for c in names})
    if strategy == "mode":
        row = df.agg(*(F.mode(c, True).alias(c) for c in names)).first()
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c]).cast(kinds[c])) for c in names if row[c] is not None})
    if strategy in ("constant", "zero"):
        fill = 0 if strategy == "zero" else value
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill).cast(kinds[c])) for c in names})
    if strategy in ("forward", "backward"):
        if not order_by:
            raise ValueError("forward and backward need order_by")
        return _carry(df, names, order_by, strategy == "forward", group_by)
    raise ValueError(f"unknown strategy {strategy!r}")


def _carry(df: DataFrame, names: list[str], order_by: list[str], forward: bool, group_by: list[str] | None) -> DataFrame:
    from .ordering import PART, ranged

    # backward is the last known value in the opposite order: a frame that ends with the last row is worked out anew for each row
    near = (Window.unboundedPreceding, Window.currentRow)
    keys = [F.asc_nulls_first(c) if forward else F.desc_nulls_last(c) for c in order_by]
    if group_by:
        w = Window.partitionBy(*group_by).orderBy(*keys).rowsBetween(*near)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})
    rows = ranged(df, order_by)
    key = F.struct(*order_by)
    pick = F.max_by if forward else F.min_by
    ends = rows.groupBy(PART).agg(*(pick(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"__e_{c}") for c in names))
    side = Window.orderBy(PART if forward else F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = ends.select(PART, *(F.last(f"__e_{c}", ignorenulls=True).over(side).alias(f"__c_{c}") for c in names))
    w = Window.partitionBy(PART).orderBy(*keys).rowsBetween(*near)
    rows = rows.join(F.broadcast(ends), PART)
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__c_{c}")) for c in names}).select(*df.columns)


def deduplicate(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None) -> DataFrame:
    """Keep the first, last, any or none of the rows of equal keys (null equals null).

    The kept row is found by a grouped minimum, which combines before the
    shuffle, so a frequent key is no hot partition.
    """
    keys = subset or df.columns
    missing(df, keys)
    if keep == "any" or subset is None and keep in ("first", "last"):
        return df.dropDuplicates(keys)
    if keep == "none":
        once = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
        cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        return df.alias("a").join(once.alias("b"), cond, "left_semi")
    order = order_by or []
    if not order:
        raise ValueError("first and last need order_by")
    pick = F.min if keep == "first" else F.max
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*order, *(c for c in rest if c not in order))).alias("__row")
    out = df.groupBy(*keys).agg(row)
    return out.select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns))


def cast(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Cast strictly; the column moves to the end."""
    missing(df, [column])
    if dtype.lower() not in TYPES:
        raise ValueError(f"unknown type {dtype!r}")
    return _at_end(df, column, F.col(column).cast(TYPES[dtype.lower()]))


def cast_columns(df: DataFrame, casts: list[tuple[str, str]]) -> DataFrame:
    for c in casts:
        df = cast(df, *c)
    return df


def clip(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    missing(df, [column])
    c = F.col(column).cast("double")
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return _at_end(df, column, out)


def replace(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Replace a value; doubles match within machine epsilon, types that are neither number nor string stay as they are."""
    missing(df, [column])
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "string":
        return _at_end(df, column, F.when(c == F.lit(old), F.lit(new)).otherwise(c))
    if kind in ("float", "double"):
        return _at_end(df, column, F.when(F.abs(c - F.lit(float(old))) < _EPSILON, F.lit(float(new)).cast(kind)).otherwise(c))
    if kind in _NUMERIC:
        return _at_end(df, column, F.when(c == F.lit(int(old)), F.lit(int(new)).cast(kind)).otherwise(c))
    return df


def trim(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip Unicode white space at both ends of string columns."""
    names = columns or [c for c, k in df.dtypes if k == "string"]
    return df.withColumns({c: F.regexp_replace(_string(df, c), r"(?U)^\s+|\s+$", "") for c in names})


def to_lowercase(df: DataFrame, column: str) -> DataFrame:
    return _at_end(df, column, F.lower(_string(df, column)))


def to_uppercase(df: DataFrame, column: str) -> DataFrame:
    return _at_end(df, column, F.upper(_string(df, column)))


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Replace every match."""
    re.compile(pattern)
    return _at_end(df, column, F.regexp_replace(_string(df, column), pattern, replacement))


regex_replace_all = regex_replace


def regex_extract(df: DataFrame, column: str, pattern: str, new_column: str, group: int = 0) -> DataFrame:
    """The group's text in the first match, null without one."""
    c = _string(df, column)
    return _at_end(df, new_column, F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)))


def regex_extract_all(df: DataFrame, column: str, pattern: str, new_column: str, separator: str = ",") -> DataFrame:
    c = _string(df, column)
    return _at_end(df, new_column, F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), separator))


def regex_count(df: DataFrame, column: str, pattern: str, new_column: str) -> DataFrame:
    return _at_end(df, new_column, F.regexp_count(_string(df, column), F.lit(pattern)).cast("bigint"))


def str_split(df: DataFrame, column: str, pattern: str, prefix: str, max_splits: int | None = None) -> DataFrame:
    """Split into columns ``prefix_0``, ``prefix_1``, ...; one pass finds how many."""
    parts = F.split(_string(df, column), pattern, -1 if max_splits is None else max_splits + 1)
    width = df.agg(F.max(F.size(parts))).first()[0] or 0
    return df.withColumns({f"{prefix}_{i}": F.get(parts, F.lit(i)) for i in range(max(0, width))})


def str_concat(df: DataFrame, columns: list[str], new_column: str, separator: str = "") -> DataFrame:
    """Joined values; nulls are left out."""
    missing(df, columns)
    return _at_end(df, new_column, F.concat_ws(separator, *(F.col(c).cast("string") for c in columns)))


def str_pad(df: DataFrame, column: str, width: int, pad: str = " ", side: str = "left") -> DataFrame:
    """Pad to a width; longer strings stay whole."""
    c = _string(df, column)
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    f = F.lpad if side == "left" else F.rpad
    return _at_end(df, column, F.when(F.length(c) < width, f(c, width, pad)).otherwise(c))


def str_substring(df: DataFrame, column: str, start: int, length: int | None = None) -> DataFrame:
    """From ``start`` (0-based; negative counts from the end)."""
    c = _string(df, column)
    begin = F.lit(start + 1) if start >= 0 else F.greatest(F.length(c) + start + 1, F.lit(1))
    return _at_end(df, column, c.substr(begin, F.lit(length) if length is not None else F.length(c)))


def str_length(df: DataFrame, column: str, new_column: str) -> DataFrame:
    """Code points."""
    return _at_end(df, new_column, F.char_length(_string(df, column)).cast("bigint"))
