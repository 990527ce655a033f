"""Features: shifts, differences, running totals, scaling, binning, one-hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import missing, running, shifted
from .ranks import rank
from .reshape import distinct_values
from .transform import ratio

__all__ = ["bin_column", "cumprod", "cumsum", "diff", "lag", "lead", "normalize", "one_hot_encode", "pct_change", "rank", "standardize"]


def lag(df: DataFrame, column: str, order_by: list[str], periods: int = 1, group_by: list[str] | None = None) -> DataFrame:
    return shifted(df, column, periods, order_by, f"{column}_lag{periods}", group_by)


def lead(df: DataFrame, column: str, order_by: list[str], periods: int = 1, group_by: list[str] | None = None) -> DataFrame:
    return shifted(df, column, -periods, order_by, f"{column}_lead{periods}", group_by)


def diff(df: DataFrame, column: str, order_by: list[str], periods: int = 1) -> DataFrame:
    rows = shifted(df, column, periods, order_by, "__before")
    return rows.select(*df.columns, (F.col(column) - F.col("__before")).alias(f"{column}_diff{periods}"))


def pct_change(df: DataFrame, column: str, order_by: list[str], periods: int = 1) -> DataFrame:
    rows = shifted(df, column, periods, order_by, "__before")
    now, before = F.col(column).cast("double"), F.col("__before").cast("double")
    return rows.select(*df.columns, ratio(now - before, before).alias(f"{column}_pct_change{periods}"))


def cumsum(df: DataFrame, column: str, order_by: list[str], reverse: bool = False) -> DataFrame:
    return running(df, column, order_by, f"{column}_cumsum", "sum", reverse)


def cumprod(df: DataFrame, column: str, order_by: list[str], reverse: bool = False) -> DataFrame:
    return running(df, column, order_by, f"{column}_cumprod", "product", reverse)


def _scalars(df: DataFrame, columns: list[str], *makers) -> dict:
    missing(df, columns)
    return df.agg(*(m(F.col(c).cast("double")).alias(f"{i}_{c}") for c in columns for i, m in enumerate(makers))).first().asDict()


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0, standard deviation 1 (n - 1)."""
    s = _scalars(df, columns, F.avg, F.stddev_samp)
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumns({f"{c}_standardized": ratio(F.col(c).cast("double") - lit(s[f"0_{c}"]), lit(s[f"1_{c}"])) for c in columns})


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """From 0 to 1."""
    s = _scalars(df, columns, F.min, F.max)
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumns({f"{c}_normalized": ratio(F.col(c).cast("double") - lit(s[f"0_{c}"]), lit(s[f"1_{c}"]) - lit(s[f"0_{c}"])) for c in columns})


def bin_column(df: DataFrame, column: str, strategy: str = "equal_width", bins: int = 5, edges: list[float] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Bins (low, high] named ``bin_0``, ... or by labels; the least value, nulls and values outside go to the first."""
    missing(df, [column])
    c = F.col(column).cast("double")
    if strategy == "equal_width":
        low, high = df.agg(F.min(c), F.max(c)).first()
        edges = [low + (high - low) * i / bins for i in range(bins + 1)] if low is not None else [0.0, 1.0]
    elif strategy == "quantile":
        got = df.agg(F.percentile(c, [i / bins for i in range(bins + 1)])).first()[0]
        edges = list(got or [0.0, 1.0])
    elif not edges:
        raise ValueError("custom bins need edges")
    names = labels or [f"bin_{i}" for i in range(len(edges) - 1)]
    out = F.lit(names[0])
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(names[i])).otherwise(out)
    return df.withColumn(f"{column}_binned", out)


def one_hot_encode(df: DataFrame, column: str, drop_first: bool = False) -> DataFrame:
    """A 0/1 column per value, in the values' order."""
    missing(df, [column])
    values = [v for v in distinct_values(df, column) if v is not None][int(drop_first) :]
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values})
