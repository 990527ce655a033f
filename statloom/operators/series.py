"""Time series over an explicit order: autocorrelation, smoothing, decomposition, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import p_value
from .ordering import INDEX, indexed

SPAN = 4096


def lagged_products(df: DataFrame, column: str, order_by: list[str], lags: int, other: str | None = None) -> DataFrame:
    """(lag, s): sums of centred products x[t] * y[t + lag].

    Places are cut into spans; the head of each span is repeated in the span
    before, so that windows never cross a partition of more than a span.
    """
    y = other or column
    mean = df.agg(F.avg(column).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n")).first()
    rows = indexed(df.select(*dict.fromkeys([column, y, *order_by])), order_by)
    rows = rows.select(INDEX, (F.col(column).cast("double") - mean["mx"]).alias("x"), (F.col(y).cast("double") - mean["my"]).alias("y"))
    span = max(SPAN, lags)
    block = F.floor(F.col(INDEX) / span)
    rows = rows.withColumn("own", F.lit(True)).withColumn("block", block)
    again = rows.where((F.col(INDEX) % span < lags) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))
    w = Window.partitionBy("block").orderBy(INDEX)
    rows = rows.unionByName(again).withColumns({f"y{k}": F.lead("y", k).over(w) for k in range(lags + 1)}).where("own")
    sums = rows.agg(*(F.sum(F.col("x") * F.col(f"y{k}")).alias(f"s{k}") for k in range(lags + 1)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(lags + 1)))))


def acf(df: DataFrame, column: str, order_by: list[str], lags: int = 10) -> DataFrame:
    rows = lagged_products(df, column, order_by, lags)
    zero = rows.where("lag = 0").select(F.col("s").alias("s0"))
    return rows.crossJoin(zero).select("lag", (F.col("s") / F.col("s0")).alias("acf"))  # one row


def ccf(df: DataFrame, x: str, y: str, order_by: list[str], lags: int = 10) -> DataFrame:
    """Correlation of x[t] with y[t + lag]."""
    s = df.agg(F.count("*").alias("n"), F.stddev_pop(x).alias("a"), F.stddev_pop(y).alias("b")).first()
    return lagged_products(df, x, order_by, lags, y).select("lag", (F.col("s") / (s["n"] * s["a"] * s["b"])).alias("ccf"))


def pacf(df: DataFrame, column: str, order_by: list[str], lags: int = 10) -> list[float]:
    """Partial autocorrelations from lag 1, by the Durbin-Levinson recursion on the autocorrelations."""
    r = [row["acf"] for row in acf(df, column, order_by, lags).orderBy("lag").collect()]  # lags + 1 rows
    out, phi = [], []
    for k in range(1, lags + 1):
        top = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        v = top / (1 - sum(p * r[j + 1] for j, p in enumerate(phi)))
        phi = [p - v * q for p, q in zip(phi, reversed(phi), strict=True)] + [v]
        out.append(v)
    return out


def ljung_box(df: DataFrame, column: str, order_by: list[str], lags: int = 10) -> DataFrame:
    n = df.count()
    s = acf(df, column, order_by, lags).where("lag > 0").agg((n * (n + 2) * F.sum(F.col("acf") ** 2 / (n - F.col("lag")))).alias("statistic"))
    return s.withColumn("df", F.lit(float(lags))).withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def durbin_watson(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    from .ordering import shifted

    rows = shifted(df.select(*dict.fromkeys([column, *order_by])), column, 1, order_by, "__b")
    return rows.agg((F.sum((F.col(column) - F.col("__b")) ** 2) / F.sum(F.col(column) ** 2)).alias("statistic"))


def moving(df: DataFrame, column: str, order_by: list[str], before: int, after: int = 0, kind: str = "mean", name: str = "moving") -> DataFrame:
    """Moving mean, sum, minimum, maximum or median over rows, in spans with repeated edges."""
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}[kind]
    rows = indexed(df, order_by)
    span = max(SPAN, before, after)
    at = F.col(INDEX)
    blocks = F.array_distinct(F.transform(F.array(at - after, at, at + before), lambda i: F.floor(i / span)))
    rows = rows.withColumn("__home", F.floor(at / span)).withColumn("__block", F.explode(F.filter(blocks, lambda b: b >= 0)))
    w = Window.partitionBy("__block").orderBy(INDEX).rowsBetween(-before, after)
    return rows.withColumn(name, f(F.col(column).cast("double")).over(w)).where("__home = __block").select(*df.columns, name)


def decompose(df: DataFrame, column: str, order_by: list[str], period: int) -> DataFrame:
    """Additive classical decomposition: centred moving average, mean by season, remainder."""
    h = period // 2
    full = moving(df, column, order_by, h, h, "sum", "__s")
    if period % 2 == 0:  # the ends count half
        full = moving(full, column, order_by, h, h - 1, "sum", "__a")
        full = moving(full, column, order_by, h - 1, h, "sum", "__b")
        trend = (F.col("__a") + F.col("__b")) / (2 * period)
    else:
        trend = F.col("__s") / period
    rows = indexed(full, order_by)
    n = df.count()
    inside = (F.col(INDEX) >= h) & (F.col(INDEX) < n - h)
    rows = rows.withColumn("trend", F.when(inside, trend)).withColumn("__k", F.col(INDEX) % period)
    season = rows.groupBy("__k").agg(F.avg(F.col(column) - F.col("trend")).alias("__m"))
    centre = season.agg(F.avg("__m").alias("__c"))
    season = season.crossJoin(centre).select("__k", (F.col("__m") - F.col("__c")).alias("seasonal"))  # one row
    rows = rows.join(F.broadcast(season), "__k")  # a row per season
    return rows.select(*df.columns, "trend", "seasonal", (F.col(column) - F.col("trend") - F.col("seasonal")).alias("remainder"))
