"""Global row order without a single-partition window.

Rows are dealt into ranges of the first order column (quantiles of it, found in
one pass), numbered within each range, and shifted by the totals of the ranges
before. Only one row per range is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART, INDEX = "__part", "__index"
#: Rows per range of the sample that cuts ranges of tuples.
SAMPLED = 40


def missing(df: DataFrame, columns: list[str]) -> None:
    """Raise if a column isn't there."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}; there are {', '.join(df.columns)}")


def _rank_value(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "timestamp_ntz":
        c = c.cast("timestamp")
    return F.unix_micros(c).cast("double") if kind.startswith("timestamp") else F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def _below(bounds: list[Column], value: Column) -> Column:
    """How many of the ascending bounds are below a value; two levels keep the search short."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if len(groups) == 1:
        return F.size(F.filter(F.array(*bounds), lambda b: b < value))
    whole = F.size(F.filter(F.array(*(g[-1] for g in groups)), lambda b: b < value))
    fine = F.array(*(F.array(*g) for g in groups), F.slice(F.array(bounds[0]), 1, 0))
    return whole * step + F.size(F.filter(F.element_at(fine, whole + 1), lambda b: b < value)) - F.when(whole == len(groups), len(groups) * step - len(bounds)).otherwise(0)


def ranged(df: DataFrame, order_by: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with the number of its range; rows of equal order values share a range, nulls come first.

    Ranges of one number or date are cut at its quantiles; text and several
    columns are cut between whole tuples of a sample of about ``SAMPLED`` rows a
    range, so that long common beginnings or frequent first values are split.
    """
    missing(df, order_by)
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)
    if len(order_by) == 1 and kinds[order_by[0]] not in ("string", "boolean", "binary"):
        value = _rank_value(df, order_by[0])
        cuts = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
        return df.withColumn(PART, F.when(value.isNull(), F.lit(-1)).otherwise(_below([F.lit(c) for c in sorted(set(cuts or []))], value)))
    key = F.struct(*order_by)
    sample = df.select(*order_by).sample(min(1.0, SAMPLED * n / max(1, df.count())), seed=5).collect() if n > 1 else []
    rows = sorted({tuple(r) for r in sample}, key=lambda r: tuple((v is not None, v) for v in r))
    cuts = list(dict.fromkeys(rows[k * len(rows) // n] for k in range(1, n))) if rows else []
    bounds = [F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order_by, r, strict=True))) for r in cuts]
    return df.withColumn(PART, _below(bounds, key))


def part_window(order_by: list[str], descending: bool = False):
    keys = [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in order_by]
    return Window.partitionBy(PART).orderBy(*keys)


def indexed(df: DataFrame, order_by: list[str]) -> DataFrame:
    """``df`` with the place of each row (from 0) in the order of ``order_by``, which should be unique."""
    rows = ranged(df, order_by)
    totals = rows.groupBy(PART).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    totals = totals.select(PART, F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.withColumn("__rank", F.row_number().over(part_window(order_by)))
    return rows.join(F.broadcast(totals), PART).withColumn(INDEX, F.col("__before") + F.col("__rank") - 1).drop(PART, "__rank", "__before")  # a row per range


def shifted(df: DataFrame, column: str, periods: int, order_by: list[str], name: str, group_by: list[str] | None = None) -> DataFrame:
    """``df`` with the value ``periods`` rows before (after, if negative); a window within groups, else an equi-join on row places."""
    missing(df, [column, *order_by, *(group_by or [])])
    if group_by:
        w = Window.partitionBy(*group_by).orderBy(*(F.asc_nulls_first(c) for c in order_by))
        return df.withColumn(name, F.lag(column, periods).over(w))
    rows = indexed(df, order_by)
    other = rows.select((F.col(INDEX) + periods).alias(INDEX), F.col(column).alias("__shifted"))
    return rows.join(other, INDEX, "left").select(*df.columns, F.col("__shifted").alias(name))


def running(df: DataFrame, column: str, order_by: list[str], name: str, kind: str = "sum", reverse: bool = False) -> DataFrame:
    """``df`` with the running sum, product, maximum or minimum of a column: within ranges, then over the totals of the ranges before."""
    missing(df, [column, *order_by])
    return running_all(ranged(df, order_by), {name: F.col(column)}, order_by, kind, reverse).select(*df.columns, name)


def running_all(rows: DataFrame, values: dict[str, Column], order_by: list[str], kind: str = "sum", reverse: bool = False) -> DataFrame:
    """Rows that ranged() has dealt, with a running total per name: one aggregate of the ranges and one window for all of them."""
    agg = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}[kind]
    join = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b, "max": F.greatest, "min": F.least}[kind]
    names = list(values)
    out = [c for c in rows.columns if c not in names]
    rows = rows.withColumns({f"__value{i}": c.cast("double") for i, c in enumerate(values.values())})
    totals = rows.groupBy(PART).agg(*(agg(f"__value{i}").alias(f"__total{i}") for i in range(len(names))))
    side = Window.orderBy(F.desc(PART) if reverse else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select(PART, *(agg(f"__total{i}").over(side).alias(f"__carry{i}") for i in range(len(names))))
    w = part_window(order_by, reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(totals), PART).withColumns({f"__own{i}": agg(f"__value{i}").over(w) for i in range(len(names))})

    def whole(i: int) -> Column:
        carry, own = F.col(f"__carry{i}"), F.col(f"__own{i}")
        both = F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(join(carry, own))
        return F.when(F.col(f"__value{i}").isNotNull(), both)

    return rows.select(*out, *(whole(i).alias(n) for i, n in enumerate(names)))
