"""Joins, stacking and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import INDEX, indexed, missing

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "anti": "left_anti", "semi": "left_semi"}


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equi-join on keys that may differ by name; nulls don't match.

    Clashing right names get the suffix. Inner and left joins drop the right
    keys, a right join drops the left ones, a full join keeps both.
    """
    right_on = right_on or left_on
    if len(left_on) != len(right_on):
        raise ValueError("as many right keys as left keys are needed")
    missing(left, left_on)
    missing(right, right_on)
    how = KINDS[how]
    marked = right.select(*(F.col(c).alias(f"__r_{c}") for c in right.columns))
    cond = reduce(Column.__and__, (left[a] == marked[f"__r_{b}"] for a, b in zip(left_on, right_on, strict=True)))
    out = left.join(marked, cond, how)
    if how in ("left_anti", "left_semi"):
        return out
    lefts = [c for c in left.columns if not (how == "right" and c in left_on)]
    rights = [c for c in right.columns if c not in right_on] if how in ("inner", "left") else list(right.columns)
    named = [F.col(f"__r_{c}").alias(f"{c}{suffix}" if c in lefts else c) for c in rights]
    return out.select(*(F.col(c) for c in lefts), *named)


def left_join(left, right, on, right_on=None, suffix="_right"):
    return join(left, right, on, right_on, "left", suffix)


def right_join(left, right, on, right_on=None, suffix="_right"):
    return join(left, right, on, right_on, "right", suffix)


def inner_join(left, right, on, right_on=None, suffix="_right"):
    return join(left, right, on, right_on, "inner", suffix)


def full_join(left, right, on, right_on=None, suffix="_right"):
    return join(left, right, on, right_on, "full", suffix)


def anti_join(left, right, on, right_on=None):
    return join(left, right, on, right_on, "anti")


def semi_join(left, right, on, right_on=None):
    return join(left, right, on, right_on, "semi")


def cross_join(left: DataFrame, right: DataFrame, suffix: str = "_right") -> DataFrame:
    """Every row with every row: the operator's own meaning, for small tables."""
    return left.crossJoin(right.select(*(F.col(c).alias(f"{c}{suffix}" if c in left.columns else c) for c in right.columns)))


def concat(frames: list[DataFrame]) -> DataFrame:
    """Stacked rows; columns that a frame lacks are null."""
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hconcat(frames: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Columns side by side, rows matched by their place in each frame's own order; the row counts must agree."""
    counts = {df.count() for df, _ in frames}
    if len(counts) > 1:
        raise ValueError(f"row counts differ: {sorted(counts)}")
    out, seen = None, set()
    for df, order in frames:
        if seen & set(df.columns):
            raise ValueError(f"columns clash: {sorted(seen & set(df.columns))}")
        seen |= set(df.columns)
        rows = indexed(df, order)
        out = rows if out is None else out.join(rows, INDEX)
    return out.drop(INDEX)


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """For each left row the latest right values at or before ``on``, within ``by``: one union and one window."""
    from pyspark.sql import Window

    keep = [c for c in left.columns]
    a = left.withColumns({f"__v_{v}": F.lit(None).cast(dict(right.dtypes)[v]) for v in values}).withColumn("__left", F.lit(1))
    b = right.select(*by, on, *(F.col(v).alias(f"__v_{v}") for v in values)).withColumn("__left", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumns({f"{v}_asof": F.last(f"__v_{v}", ignorenulls=True).over(w) for v in values})
    return both.where("__left = 1").select(*keep, *(f"{v}_asof" for v in values))
