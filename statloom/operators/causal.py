"""Treatment effects from cells, weights and local fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import p_value
from . import moments


def did(df: DataFrame, y: str, treated: str, post: str) -> DataFrame:
    """Two-by-two difference in differences from four cell means, with unequal-variance errors."""
    cells = {f"{a}{b}": F.when((F.col(treated) == a) & (F.col(post) == b), F.col(y).cast("double")) for a in (0, 1) for b in (0, 1)}
    s = df.agg(*(f(c).alias(f"{n}{k}") for k, c in cells.items() for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    att = (F.col("m11") - F.col("m10")) - (F.col("m01") - F.col("m00"))
    se = F.sqrt(sum((F.col(f"v{k}") / F.col(f"n{k}") for k in cells), F.lit(0.0)))
    s = s.select(att.alias("att"), se.alias("std_error"), (att / se).alias("statistic"))
    return s.withColumn("p_value", p_value("z", F.col("statistic")))


def event_study(df: DataFrame, y: str, treated: str, period: str, base) -> DataFrame:
    """Difference of treated and other means per period, less that of the base period."""
    m = lambda k: F.avg(F.when(F.col(treated) == k, F.col(y).cast("double")))
    c = df.groupBy(F.col(period).alias("period")).agg((m(1) - m(0)).alias("d")).where("d is not null")
    at = c.where(F.col("period") == F.lit(base)).select(F.col("d").alias("d0"))
    return c.crossJoin(at).select("period", (F.col("d") - F.col("d0")).alias("effect"))  # one row


def _score(df: DataFrame, treatment: str, covariates: list[str], trim: float):
    fit = moments.glm(df, treatment, covariates, "logit")
    z = sum((float(b) * (F.lit(1.0) if n == moments.ONE else F.col(n).cast("double")) for n, b in zip(fit.names, fit.coef, strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    return F.least(F.greatest(p, F.lit(trim)), F.lit(1 - trim))


def ipw(df: DataFrame, y: str, treatment: str, covariates: list[str], estimand: str = "ate", trim: float = 0.01) -> DataFrame:
    """Normalised inverse-probability weights from a logit score."""
    p, d, v = _score(df, treatment, covariates, trim), F.col(treatment).cast("double"), F.col(y).cast("double")
    w1, w0 = {"ate": (d / p, (1 - d) / (1 - p)), "att": (d, (1 - d) * p / (1 - p)), "atc": (d * (1 - p) / p, 1 - d)}[estimand]
    s = df.agg((F.sum(w1 * v) / F.sum(w1)).alias("m1"), (F.sum(w0 * v) / F.sum(w0)).alias("m0"), F.count("*").alias("n"))
    return s.select(F.lit(estimand).alias("estimand"), (F.col("m1") - F.col("m0")).alias("effect"), "n")


def aipw(df: DataFrame, y: str, treatment: str, covariates: list[str], trim: float = 0.01) -> DataFrame:
    """Doubly robust average effect: linear outcome models and a logit score; error from the influence function."""
    p, d, v = _score(df, treatment, covariates, trim), F.col(treatment).cast("double"), F.col(y).cast("double")
    mu = []
    for k in (1, 0):
        fit = moments.ols(df.where(F.col(treatment) == k), y, covariates)
        mu.append(sum((float(b) * (F.lit(1.0) if n == moments.ONE else F.col(n).cast("double")) for n, b in zip(fit.names, fit.coef, strict=True)), F.lit(0.0)))
    score = mu[0] - mu[1] + d * (v - mu[0]) / p - (1 - d) * (v - mu[1]) / (1 - p)
    s = df.agg(F.avg(score).alias("effect"), (F.stddev_samp(score) / F.sqrt(F.count("*"))).alias("std_error"))
    s = s.withColumn("statistic", F.col("effect") / F.col("std_error"))
    return s.withColumn("p_value", p_value("z", F.col("statistic")))


def rd_local_linear(df: DataFrame, y: str, running: str, cutoff: float, bandwidth: float) -> DataFrame:
    """Sharp discontinuity: triangular-kernel local lines on either side, from weighted sums."""
    x, v = F.col(running).cast("double") - cutoff, F.col(y).cast("double")
    w = 1 - F.abs(x) / bandwidth
    rows = df.where(F.abs(x) < bandwidth).select((x >= 0).alias("s"), x.alias("x"), v.alias("y"), w.alias("w"))
    f = rows.groupBy("s").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") ** 2).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"), F.count("*").alias("n"))
    a = (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / (F.col("w") * F.col("sxx") - F.col("sx") ** 2)
    side = lambda c, s: F.max(F.when(F.col("s") == s, c))
    return f.agg((side(a, True) - side(a, False)).alias("effect"), side(F.col("n"), False).alias("n_left"), side(F.col("n"), True).alias("n_right"))
