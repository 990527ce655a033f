"""Survival curves and tests from counts per time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .ordering import PART, ranged, running_all

#: Groups that a test compares at most; more are refused.
MAX_GROUPS = 200


def _rows(df: DataFrame, time: str, event: str, *more) -> DataFrame:
    return df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), *more).where("time is not null and time >= 0 and not isnan(time) and event is not null")


def labels(df: DataFrame, column: str) -> list:
    """The sorted values of a column of groups; more than ``MAX_GROUPS`` are refused."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MAX_GROUPS + 1).collect()]
    if len(found) > MAX_GROUPS:
        raise ValueError(f"{column} has more than {MAX_GROUPS} groups")
    return found


def kaplan_meier(df: DataFrame, time: str, event: str, level: float = 0.95) -> DataFrame:
    """time, n_risk, n_event, survival, Greenwood's std_error, limits on the log scale and the Nelson-Aalen hazard."""
    by = _rows(df, time, event).groupBy("time").agg(F.sum("event").alias("n_event"), F.count("*").alias("n"))
    life = running_all(ranged(by, ["time"]), {"n_risk": F.col("n")}, ["time"], reverse=True)
    d, r = F.col("n_event").cast("double"), F.col("n_risk")
    life = running_all(life, {"__q": F.ln(F.when(d < r, 1 - d / r)), "__g": F.when(d < r, d / (r * (r - d))), "hazard": d / r, "__z": (d >= r).cast("int")}, ["time"])
    survival = F.when(F.col("__z") > 0, 0.0).otherwise(F.exp("__q"))
    z = special.normal_quantile((1 + level) / 2)
    limit = lambda k: F.when(F.col("__z") > 0, F.lit(None)).otherwise(F.least(F.lit(1.0), F.exp(F.col("__q") + k * z * F.sqrt("__g"))))
    return life.select("time", F.col("n_risk").cast("long").alias("n_risk"), "n_event", survival.alias("survival"), (survival * F.sqrt("__g")).alias("std_error"), limit(-1).alias("low"), limit(1).alias("high"), "hazard")


def kaplan_meier_by(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """A curve per group."""
    out = None
    for g in labels(df, group):
        one = kaplan_meier(df.where(F.col(group) == F.lit(g)), time, event).withColumn(group, F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out


def log_rank(df: DataFrame, time: str, event: str, group: str, weight: str = "log-rank") -> DataFrame:
    """Log-rank test of all groups (or Gehan's, weighted by the numbers at risk): a row per group with the statistic, its degrees of freedom and p-value."""
    names = labels(df, group)
    k = len(names)
    rows = _rows(df, time, event, F.col(group).alias("g")).where("g is not null")
    counts = [c for i, g in enumerate(names) for c in (F.sum(F.when(F.col("g") == F.lit(g), F.col("event")).otherwise(0)).alias(f"d{i}"), F.count_if(F.col("g") == F.lit(g)).alias(f"n{i}"))]
    by = ranged(rows.groupBy("time").agg(F.sum("event").alias("d"), F.count("*").alias("n"), *counts), ["time"])
    by = running_all(by, {"r": F.col("n"), **{f"r{i}": F.col(f"n{i}") for i in range(k)}}, ["time"], reverse=True).drop(PART)
    d, r = F.col("d").cast("double"), F.col("r")
    w = r if weight == "gehan" else F.lit(1.0)
    spread = F.when(r > 1, d * (r - d) / (r - 1)).otherwise(0.0) * w * w
    share = [F.col(f"r{i}") / r for i in range(k)]
    cells = [F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)]
    s = by.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k)), *(F.sum(F.col(f"d{i}")).alias(f"o{i}") for i in range(k)), *(F.sum(d * share[i]).alias(f"e{i}") for i in range(k)), *(F.sum(w * (F.col(f"d{i}") - d * share[i])).alias(f"u{i}") for i in range(k)), *cells).first()
    v = np.array([[s[f"v{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    u = np.array([s[f"u{i}"] for i in range(k)])
    stat = float(u[:-1] @ np.linalg.solve(v[:-1, :-1], u[:-1])) if k > 1 else float("nan")
    p = special.chi2_upper(stat, k - 1) if k > 1 else float("nan")
    kind = dict(df.dtypes)[group]
    out = [(g, int(s[f"n{i}"]), int(s[f"o{i}"]), float(s[f"e{i}"]), stat, k - 1, p) for i, g in enumerate(names)]
    return df.sparkSession.createDataFrame(out, f"group {kind}, n long, observed long, expected double, statistic double, df int, p_value double")
