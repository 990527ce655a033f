"""Spatial statistics and lag models over a table of neighbours (i, j, w)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .models import residuals
from .moments import ONE, Fit, ols, products


def neighbours(points: DataFrame, id_col: str, x: str, y: str, radius: float, style: str = "row") -> DataFrame:
    """(i, j, w): points within a radius by a join of grid cells; weights sum to one per point (row), or are 1 (binary) or inverse distances."""
    rows = points.select(F.col(id_col).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    cells = F.array(*(F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    left = rows.select("i", "x", "y", F.explode(cells).alias("c")).select("i", "x", "y", "c.cx", "c.cy")
    right = rows.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy")
    gap = F.sqrt((F.col("x") - F.col("xj")) ** 2 + (F.col("y") - F.col("yj")) ** 2)
    pairs = left.join(right, ["cx", "cy"]).where((F.col("i") != F.col("j")) & (gap <= radius)).select("i", "j", gap.alias("d"))
    if style == "row":
        return pairs.join(pairs.groupBy("i").agg((1 / F.count("*")).alias("w")), "i").select("i", "j", "w")
    return pairs.select("i", "j", (F.lit(1.0) if style == "binary" else 1 / F.greatest("d", F.lit(1e-12))).alias("w"))


def lagged(df: DataFrame, weights: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``df`` with w_<column>, the weighted sum over each row's neighbours (0 without any)."""
    other = df.select(F.col(id_col).alias("j"), *(F.col(c).cast("double").alias(f"w_{c}") for c in columns))
    sums = weights.join(other, "j").groupBy("i").agg(*(F.sum(F.col("w") * F.col(f"w_{c}")).alias(f"w_{c}") for c in columns))
    return df.join(sums.withColumnRenamed("i", "__i"), F.col(id_col) == F.col("__i"), "left").drop("__i").fillna(0.0, [f"w_{c}" for c in columns])


def _weight_sums(weights: DataFrame) -> tuple[float, float, float]:
    """S0, S1 and S2 of a table of weights."""
    back = weights.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    s0 = weights.agg(F.sum("w")).first()[0]
    both = weights.join(back, ["i", "j"], "full").select((F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("u"))
    s1 = both.agg(F.sum(F.col("u") ** 2)).first()[0] / 2
    ends = weights.select("i", "w").union(weights.select("j", "w")).groupBy("i").agg(F.sum("w").alias("u"))
    return s0, s1, ends.agg(F.sum(F.col("u") ** 2)).first()[0]


def moran(df: DataFrame, weights: DataFrame, id_col: str, value: str) -> DataFrame:
    """Moran's I with its expectation, variance under normality, z and p-value."""
    mean, n = df.agg(F.avg(F.col(value).cast("double")), F.count("*")).first()
    rows = lagged(df.select(id_col, (F.col(value).cast("double") - mean).alias("z")), weights, id_col, ["z"])
    a, b = rows.agg(F.sum(F.col("z") * F.col("w_z")), F.sum(F.col("z") ** 2)).first()
    s0, s1, s2 = _weight_sums(weights)
    i, e = n / s0 * a / b, -1 / (n - 1)
    v = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e
    z = (i - e) / math.sqrt(v)
    return df.sparkSession.createDataFrame([(float(i), e, float(v), float(z), special.normal_two_sided(z))], "statistic double, expectation double, variance double, z double, p_value double")


def geary(df: DataFrame, weights: DataFrame, id_col: str, value: str) -> DataFrame:
    """Geary's C with its variance under normality, z and p-value."""
    rows = df.select(F.col(id_col).alias("i"), F.col(value).cast("double").alias("x"))
    n, ss = rows.agg(F.count("*"), F.var_pop("x") * F.count("*")).first()
    pairs = weights.join(rows, "i").join(rows.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    a = pairs.agg(F.sum(F.col("w") * (F.col("x") - F.col("y")) ** 2)).first()[0]
    s0, s1, s2 = _weight_sums(weights)
    c = (n - 1) * a / (2 * s0 * ss)
    v = ((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)
    z = (1 - c) / math.sqrt(v)
    return df.sparkSession.createDataFrame([(float(c), 1.0, float(v), float(z), special.normal_two_sided(z))], "statistic double, expectation double, variance double, z double, p_value double")


def local_moran(df: DataFrame, weights: DataFrame, id_col: str, value: str) -> DataFrame:
    """(id, statistic, quadrant): local indicators; quadrants tell high or low values among high or low neighbours."""
    mean, v = df.agg(F.avg(F.col(value).cast("double")), F.var_pop(F.col(value).cast("double"))).first()
    rows = lagged(df.select(id_col, (F.col(value).cast("double") - mean).alias("z")), weights, id_col, ["z"])
    side = lambda c: F.when(F.col(c) >= 0, "high").otherwise("low")
    return rows.select(id_col, (F.col("z") * F.col("w_z") / v).alias("statistic"), F.concat_ws("-", side("z"), side("w_z")).alias("quadrant"))


def lag_tests(df: DataFrame, weights: DataFrame, id_col: str, y: str, x: list[str]) -> DataFrame:
    """(test, statistic, p_value): Lagrange multiplier tests of a spatial error and a spatial lag, plain and robust."""
    fit = ols(df, y, x)
    rows = residuals(df, fit, y, "__e").withColumn("__f", F.col("fitted"))
    rows = lagged(rows, weights, id_col, ["__e", y, "__f"])
    s2 = fit.rss / fit.n
    back = weights.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    t = weights.agg(F.sum(F.col("w") ** 2)).first()[0] + (weights.join(back, ["i", "j"]).agg(F.sum(F.col("w") * F.col("v"))).first()[0] or 0.0)
    ewe, ewy = (v / s2 for v in rows.agg(F.sum(F.col("__e") * F.col("w___e")), F.sum(F.col("__e") * F.col(f"w_{y}"))).first())
    aux = ols(rows, "w___f", x)
    j = t + aux.rss / s2
    out = [("error", ewe**2 / t), ("lag", ewy**2 / j), ("robust error", (ewe - t / j * ewy) ** 2 / (t - t * t / j)), ("robust lag", (ewy - ewe) ** 2 / (j - t))]
    return df.sparkSession.createDataFrame([(k, float(v), special.chi2_upper(v, 1)) for k, v in out], "test string, statistic double, p_value double")


def spatial_lag(df: DataFrame, weights: DataFrame, id_col: str, y: str, x: list[str]) -> Fit:
    """Spatial lag model by two-stage least squares: neighbours' regressors and theirs in turn are instruments."""
    from .moments import iv_2sls

    one = lagged(df.select(id_col, y, *x), weights, id_col, [y, *x])
    two = lagged(one, weights, id_col, [f"w_{c}" for c in x])
    fit = iv_2sls(two, y, x, [f"w_{y}"], [*(f"w_{c}" for c in x), *(f"w_w_{c}" for c in x)])
    fit.kind = "spatial_lag"
    return fit


def spatial_error(df: DataFrame, weights: DataFrame, id_col: str, y: str, x: list[str], rounds: int = 20) -> Fit:
    """Spatial error model by the generalised moments of the residuals and least squares of the filtered rows."""
    base = lagged(df.select(id_col, y, *x), weights, id_col, [y, *x])
    fit, lam = ols(base, y, x), 0.0
    trace = weights.agg(F.sum(F.col("w") ** 2)).first()[0]
    for _ in range(rounds):
        e = residuals(base, fit, y, "u")
        rows = lagged(lagged(e.select(id_col, "u"), weights, id_col, ["u"]), weights, id_col, ["w_u"])
        s = products(rows, [F.col("u"), F.col("w_u"), F.col("w_w_u")]) / fit.n
        t = trace / fit.n
        a = np.array([[2 * s[0, 1], -s[1, 1], 1.0], [2 * s[1, 2], -s[2, 2], t], [s[0, 2] + s[1, 1], -s[1, 2], 0.0]])
        g = np.array([s[0, 0], s[1, 1], s[0, 1]])
        loss = lambda l: min(float(((g - a @ np.array([l, l * l, v])) ** 2).sum()) for v in [max(1e-9, float((a[:, 2] @ (g - a[:, :2] @ np.array([l, l * l]))) / (a[:, 2] @ a[:, 2])))])
        grid = np.linspace(-0.99, 0.99, 1999)
        new = float(grid[int(np.argmin([loss(v) for v in grid]))])
        filtered = base.select(*((F.col(c).cast("double") - new * F.col(f"w_{c}")).alias(c) for c in [y, *x]), F.lit(1.0 - new).alias(ONE))
        fit = ols(filtered, y, [ONE, *x], intercept=False)
        done = abs(new - lam) < 1e-3
        lam = new
        if done:
            break
    fit.kind, fit.extra = "spatial_error", {"lambda": lam}
    return fit
