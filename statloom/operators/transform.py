"""Rows and columns: select, drop, rename, filter, mutate, sort, slice, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import INDEX, indexed, missing

#: Filter operators and their aliases.
ALIASES = {
    "eq": "eq", "==": "eq", "=": "eq", "ne": "ne", "!=": "ne", "<>": "ne", "gt": "gt", ">": "gt", "ge": "ge", ">=": "ge",
    "lt": "lt", "<": "lt", "le": "le", "<=": "le", "contains": "contains", "like": "contains",
    "not_contains": "not_contains", "notcontains": "not_contains", "starts_with": "starts_with", "startswith": "starts_with", "starts": "starts_with",
    "ends_with": "ends_with", "endswith": "ends_with", "ends": "ends_with", "regex": "regex", "matches": "regex", "regexp": "regex",
    "not_regex": "not_regex", "notregex": "not_regex", "not_matches": "not_regex",
}
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_TEXT = {
    "contains": lambda a, v: a.contains(v),
    "not_contains": lambda a, v: ~a.contains(v),
    "starts_with": lambda a, v: a.startswith(v),
    "ends_with": lambda a, v: a.endswith(v),
    "regex": lambda a, v: a.rlike(v),
    "not_regex": lambda a, v: ~a.rlike(v),
}
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_ARITHMETIC = {"+": "+", "add": "+", "-": "-", "sub": "-", "*": "*", "mul": "*", "/": "/", "div": "/"}


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    missing(df, columns)
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing(df, columns)
    return df.drop(*columns)


def rename(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    missing(df, list(renames))
    return df.withColumnsRenamed(renames)


def predicate(df: DataFrame, column: str, op: str, value: str) -> Column:
    """The condition ``column op value``; the value is parsed as the column's type."""
    missing(df, [column])
    name = ALIASES.get(op.lower())
    if name is None:
        raise ValueError(f"unknown operator {op!r}")
    kind, c = dict(df.dtypes)[column], F.col(column)
    if name in _TEXT:
        if kind != "string":
            raise TypeError(f"{op} needs a string column, {column} is {kind}")
        return _TEXT[name](c, str(value))
    if kind in _WHOLE:
        return _COMPARE[name](c, F.lit(int(value)))
    if kind in ("float", "double") or kind.startswith("decimal"):
        return _COMPARE[name](c, F.lit(float(value)))
    if kind == "boolean":
        if name not in ("eq", "ne"):
            raise TypeError("boolean columns can be compared with eq and ne only")
        return _COMPARE[name](c, F.lit(str(value).lower() in ("true", "1", "yes")))
    if kind == "string":
        return _COMPARE[name](c, F.lit(str(value)))
    return _COMPARE[name](c, F.lit(str(value)).cast(kind))


def filter_rows(df: DataFrame, column: str, op: str, value: str) -> DataFrame:
    return df.where(predicate(df, column, op, value))


def filter_and(df: DataFrame, conditions: list[tuple[str, str, str]]) -> DataFrame:
    for c in conditions:
        df = filter_rows(df, *c)
    return df


def ratio(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 is NaN."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    zero = F.when((a == 0) | F.isnan(a), nan).otherwise(F.when(a > 0, inf).otherwise(-inf))
    return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _logarithm(f):
    return lambda c: F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(f(F.when(c > 0, c)))


FUNCTIONS = {
    "log": _logarithm(F.ln), "ln": _logarithm(F.ln), "log10": _logarithm(F.log10), "log2": _logarithm(F.log2),
    "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "square": lambda c: c * c,
    "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"), "round": lambda c: F.round(c, 0),
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
}


def constant(value: str) -> Column:
    try:
        return F.lit(float(value))
    except ValueError:
        return F.lit(value)


def arithmetic(left: Column, op: str, right: Column) -> Column:
    a, b = left.cast("double"), right.cast("double")
    sign = _ARITHMETIC.get(op.lower())
    if sign is None:
        raise ValueError(f"unknown arithmetic operator {op!r}")
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ratio(a, b)}[sign]()


def function(name: str, column: Column) -> Column:
    if name.lower() not in FUNCTIONS:
        raise ValueError(f"unknown function {name!r}; there are {', '.join(FUNCTIONS)}")
    return FUNCTIONS[name.lower()](column.cast("double"))


def mutate(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column at the end; one of the same name is replaced. ``value`` is any expression (see constant, arithmetic, function)."""
    return df.select(*(c for c in df.columns if c != name), value.alias(name))


def sort(df: DataFrame, columns: list[str], descending: list[bool] | bool = False) -> DataFrame:
    """Nulls come first in either direction."""
    missing(df, columns)
    down = [descending] * len(columns) if isinstance(descending, bool) else list(descending) or [False]
    down = down * len(columns) if len(down) == 1 else down
    if len(down) != len(columns):
        raise ValueError("as many directions as columns are needed")
    return df.orderBy(*(F.desc_nulls_first(c) if d else F.asc_nulls_first(c) for c, d in zip(columns, down, strict=True)))


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return sort(df, order_by).limit(n)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The last rows, in order."""
    return sort(df.orderBy(*(F.desc_nulls_last(c) for c in order_by)).limit(n), order_by)


def slice_rows(df: DataFrame, offset: int, length: int, order_by: list[str]) -> DataFrame:
    """Rows from ``offset``; a negative one counts from the end."""
    if offset < 0:
        last = df.orderBy(*(F.desc_nulls_last(c) for c in order_by)).limit(-offset)
        return sort(last, order_by).limit(min(length, -offset))
    return sort(df, order_by).offset(offset).limit(length)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, with_replacement: bool = False, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """``n`` rows, or a share of them; with ``key`` the choice depends on the rows alone, not on how they are partitioned."""
    if fraction is not None and n is None:
        if key and not with_replacement:
            return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
        return df.sample(with_replacement, fraction, seed)
    if n is None:
        raise ValueError("n or fraction is needed")
    if with_replacement:
        rows = indexed(df, key or df.columns[:1])
        total = rows.count()
        picks = df.sparkSession.range(n).select(F.floor(F.rand(seed) * total).alias(INDEX))
        return picks.join(rows, INDEX).drop(INDEX)
    return df.orderBy(F.xxhash64(*(key or df.columns), F.lit(seed))).limit(n)
