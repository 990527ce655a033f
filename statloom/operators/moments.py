"""Sufficient statistics in one aggregate, and linear models from them.

Columns are shifted by their means (a first pass) before products are summed,
so that large offsets don't cancel. Only k*k numbers reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special

ONE = "(Intercept)"


def no_nulls(df: DataFrame, columns: list[str]) -> None:
    """Estimators refuse nulls."""
    bad = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    if any(bad.values()):
        raise ValueError(f"nulls in {', '.join(c for c, n in bad.items() if n)}")


def products(df: DataFrame, exprs: list[Column], weight: Column | None = None) -> np.ndarray:
    """Matrix of the sums of products of the expressions (times a weight), in one aggregate."""
    w = weight if weight is not None else F.lit(1.0)
    k = len(exprs)
    row = df.agg(*(F.sum(w * exprs[i] * exprs[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


@dataclass
class Fit:
    """Coefficients of a linear model with what its tests need."""

    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n: int
    df: int
    rss: float = float("nan")
    tss: float = float("nan")
    kind: str = "ols"
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.vcov), 0, None))

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss

    def rows(self) -> list[tuple]:
        out = []
        for i, name in enumerate(self.names):
            b, s = float(self.coef[i]), float(self.se[i])
            t = b / s if s else float("nan")
            p = special.t_two_sided(t, self.df) if self.kind not in ("logit", "probit", "poisson", "cox") else special.normal_two_sided(t)
            out.append((name, b, s, t, p if s else None))
        return out

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "term string, estimate double, std_error double, statistic double, p_value double")


def _design(df: DataFrame, x: list[str], intercept: bool) -> tuple[list[Column], list[str]]:
    cols = [F.col(c).cast("double") for c in x]
    return ([F.lit(1.0), *cols], [ONE, *x]) if intercept else (cols, list(x))


def ols(df: DataFrame, y: str, x: list[str], vcov: str = "classical", cluster: str | list[str] | None = None, weight: str | None = None, intercept: bool = True) -> Fit:
    """Least squares by the normal equations; vcov classical, HC0, HC1, HC2, HC3 or clustered.

    Robust variances take one more aggregate: residual and leverage are column
    expressions, so rows never leave the JVM.
    """
    groups = [cluster] if isinstance(cluster, str) else list(cluster or [])
    no_nulls(df, [y, *x, *groups, *([weight] if weight else [])])
    w = F.col(weight).cast("double") if weight else None
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate([y, *x])), F.count("*").alias("n")).first()
    n = means["n"]
    centre = [means[f"m{i}"] or 0.0 for i in range(len(x) + 1)] if intercept else [0.0] * (len(x) + 1)
    yc = F.col(y).cast("double") - centre[0]
    cols = [F.col(c).cast("double") - centre[i + 1] for i, c in enumerate(x)]
    cols = [F.lit(1.0), *cols] if intercept else cols
    names = [ONE, *x] if intercept else list(x)
    s = products(df, [yc, *cols], w)
    xx, xy = s[1:, 1:], s[1:, 0]
    scale = np.sqrt(np.diag(xx))
    if (scale == 0).any() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e13:
        raise ValueError("regressors are collinear")
    inv = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inv @ xy
    rss = float(s[0, 0] - xy @ beta)
    total = F.sum((w if w is not None else F.lit(1.0)) * yc)
    tss = float(s[0, 0] - (df.agg(total).first()[0] or 0.0) ** 2 / xx[0, 0]) if intercept else float(s[0, 0])
    dof = n - len(names)
    if vcov == "classical" and not groups:
        cov = inv * rss / dof
    else:
        e = yc - sum((float(b) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
        if groups:
            cov, dof = _clustered(df, groups, cols, e, w, inv, n, len(names))
        else:
            h = sum((float(inv[i, j]) * cols[i] * cols[j] for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0)) * (w if w is not None else F.lit(1.0))
            ew = e * e * (w * w if w is not None else F.lit(1.0))
            kind = vcov.upper()
            weigh = {"HC0": ew, "HC1": ew * (n / dof), "HC2": ew / (1 - h), "HC3": ew / ((1 - h) * (1 - h))}[kind]
            cov = inv @ products(df, cols, weigh) @ inv
    back = np.eye(len(names))
    if intercept:
        back[0, 1:] = -np.array(centre[1:])
        beta = back @ beta
        beta[0] += centre[0]
        cov = back @ cov @ back.T
    return Fit(names, beta, cov, n, dof, rss, tss)


def _clustered(df, groups, cols, e, w, inv, n, k):
    ew = e * (w if w is not None else F.lit(1.0))
    scores = df.groupBy(*groups).agg(*(F.sum(c * ew).alias(f"u{i}") for i, c in enumerate(cols)))
    meat = products(scores, [F.col(f"u{i}") for i in range(k)])
    g = scores.count()
    return inv @ (meat * (g / (g - 1)) * ((n - 1) / (n - k))) @ inv, g - 1


def ridge(df: DataFrame, y: str, x: list[str], penalty: float) -> Fit:
    """Ridge on standardised regressors, coefficients in the original units."""
    no_nulls(df, [y, *x])
    stats = df.agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate([y, *x]) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n = stats["n"]
    z = [(F.col(c).cast("double") - stats[f"m{i + 1}"]) / stats[f"s{i + 1}"] for i, c in enumerate(x)]
    s = products(df, [F.col(y).cast("double") - stats["m0"], *z])
    inv = np.linalg.inv(s[1:, 1:] + penalty * n * np.eye(len(x)))
    b = inv @ s[1:, 0] / np.array([stats[f"s{i + 1}"] for i in range(len(x))])
    a = stats["m0"] - sum(b[i] * stats[f"m{i + 1}"] for i in range(len(x)))
    return Fit([ONE, *x], np.array([a, *b]), np.full((len(x) + 1, len(x) + 1), np.nan), n, n - len(x) - 1, kind="ridge")


_LINKS = {
    "logit": (lambda z: 1 / (1 + F.exp(-z)), lambda z, p: p * (1 - p), lambda z, p: p * (1 - p)),
    "poisson": (lambda z: F.exp(z), lambda z, p: p, lambda z, p: p),
}


def _normal_cdf(z: Column) -> Column:
    """Normal distribution function as a column, relative error 1.2e-7."""
    t = 1 / (1 + 0.5 * F.abs(z) / np.sqrt(2))
    x = F.abs(z) / np.sqrt(2)
    #: Chebyshev coefficients of erfc (relative error 1.2e-7).
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for v in reversed(c[:-1]):
        poly = poly * t + v
    half = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1 - half).otherwise(half)


def glm(df: DataFrame, y: str, x: list[str], family: str = "logit", steps: int = 50, tolerance: float = 1e-10) -> Fit:
    """Logit, probit or Poisson by Newton's method; each step is one aggregate of score and information."""
    no_nulls(df, [y, *x])
    cols, names = _design(df, x, True)
    target = F.col(y).cast("double")
    n, mean = df.agg(F.count("*"), F.avg(target)).first()
    beta = np.zeros(len(names))
    beta[0] = {"logit": lambda m: np.log(m / (1 - m)), "probit": special.normal_quantile, "poisson": np.log}[family](min(max(mean, 1e-6), 1 - 1e-6 if family != "poisson" else mean + 1e-6))
    k = len(names)
    loglik = float("nan")
    for _ in range(steps):
        z = sum((float(b) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
        if family == "probit":
            p = F.greatest(F.least(_normal_cdf(z), F.lit(1 - 1e-12)), F.lit(1e-12))
            density = F.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)
            score, info = density * (target - p) / (p * (1 - p)), density * density / (p * (1 - p))
        else:
            mean_, _, weight = _LINKS[family]
            p = mean_(z)
            score, info = target - p, weight(z, p)
        ll = target * z - p if family == "poisson" else target * F.ln(F.greatest(p, F.lit(1e-300))) + (1 - target) * F.ln(F.greatest(1 - p, F.lit(1e-300)))
        row = df.agg(*(F.sum(score * cols[i]).alias(f"g{i}") for i in range(k)), *(F.sum(info * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)), F.sum(ll).alias("ll")).first()
        grad = np.array([row[f"g{i}"] for i in range(k)])
        hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        loglik = row["ll"]
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < tolerance * max(1.0, np.abs(beta).max()):
            break
    return Fit(names, beta, np.linalg.inv(hess), n, n - k, kind=family, extra={"log_likelihood": loglik})


def iv_2sls(df: DataFrame, y: str, exogenous: list[str], endogenous: list[str], instruments: list[str], robust: bool = False) -> Fit:
    """Two-stage least squares from one matrix of products."""
    no_nulls(df, [y, *exogenous, *endogenous, *instruments])
    if len(instruments) < len(endogenous):
        raise ValueError("as many instruments as endogenous regressors are needed")
    names = [ONE, *exogenous, *endogenous]
    c = lambda v: F.lit(1.0) if v == ONE else F.col(v).cast("double")
    every = [y, ONE, *exogenous, *endogenous, *instruments]
    means = df.agg(*(F.avg(c(v)).alias(f"m{i}") for i, v in enumerate(every))).first()
    shift = {v: 0.0 if v == ONE else means[f"m{i}"] or 0.0 for i, v in enumerate(every)}
    raw, c = c, lambda v: raw(v) - shift[v]
    s = products(df, [c(v) for v in every])
    at = {v: i for i, v in enumerate(every)}
    xi, zi = [at[v] for v in names], [at[v] for v in (ONE, *exogenous, *instruments)]
    zz, zx, zy = s[np.ix_(zi, zi)], s[np.ix_(zi, xi)], s[zi, 0]
    proj = np.linalg.solve(zz, zx)
    a = np.linalg.inv(zx.T @ proj)
    beta = a @ (proj.T @ zy)
    n = int(round(s[1, 1]))
    rss = float(s[0, 0] - 2 * beta @ s[xi, 0] + beta @ s[np.ix_(xi, xi)] @ beta)
    if robust:
        e = c(y) - sum((float(b) * c(v) for b, v in zip(beta, names, strict=True)), F.lit(0.0))
        fitted = [sum((float(proj[j, i]) * c(every[zi[j]]) for j in range(len(zi))), F.lit(0.0)) for i in range(len(xi))]
        cov = a @ products(df, fitted, e * e) @ a * n / (n - len(names))
    else:
        cov = a * rss / (n - len(names))
    back = np.eye(len(names))
    back[0, 1:] = [-shift[v] for v in names[1:]]
    beta, cov = back @ beta, back @ cov @ back.T
    beta[0] += shift[y]
    return Fit(names, beta, cov, n, n - len(names), rss, float(s[0, 0] - s[0, 1] ** 2 / n), extra={"overidentified": len(instruments) - len(endogenous)})


def demeaned(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Columns minus their group means; the means are grouped first and joined back."""
    means = df.groupBy(by).agg(*(F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in columns))
    return df.join(means.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).withColumns({c: F.col(c).cast("double") - F.col(f"__m_{c}") for c in columns}).drop("__by", *(f"__m_{c}" for c in columns))


def fixed_effects(df: DataFrame, y: str, x: list[str], entity: str, cluster: bool = False) -> Fit:
    """Within estimator; the degrees of freedom count the entities."""
    groups = df.select(entity).distinct().count()
    fit = ols(demeaned(df, [y, *x], entity), y, x, cluster=entity if cluster else None, intercept=False)
    if not cluster:
        dof = fit.n - groups - len(x)
        fit.vcov, fit.df = fit.vcov * fit.df / dof, dof
    fit.kind = "fixed_effects"
    fit.extra["n_groups"] = groups
    return fit


def random_effects(df: DataFrame, y: str, x: list[str], entity: str) -> Fit:
    """Swamy-Arora quasi-demeaning with each entity's own theta."""
    no_nulls(df, [y, *x, entity])
    every, k = [y, *x], len(x)
    centre = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(every))).first()
    z = [F.col(c).cast("double") - centre[f"m{i}"] for i, c in enumerate(every)]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    # sums and products per entity hold the within, between and quasi-demeaned moments; rows are read once
    g = df.groupBy(entity).agg(F.count("*").alias("t"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs))
    t = F.col("t").cast("double")
    mean = [F.col(f"s{i}") / t for i in range(k + 1)]
    one = g.agg(F.count("*").alias("g"), F.sum("t").alias("n"), F.sum(1 / t).alias("h"), *(F.sum(m).alias(f"b{i}") for i, m in enumerate(mean)), *(F.sum(F.col(f"p{i}_{j}") - t * mean[i] * mean[j]).alias(f"w{i}_{j}") for i, j in pairs), *(F.sum(mean[i] * mean[j]).alias(f"q{i}_{j}") for i, j in pairs)).first()
    full = lambda name: np.array([[one[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    within, between, groups, n = full("w"), full("q"), one["g"], int(one["n"])
    b = np.linalg.solve(within[1:, 1:], within[1:, 0])
    sigma_e = float(within[0, 0] - b @ within[1:, 0]) / (n - groups - k)
    total = np.array([one[f"b{i}"] for i in range(k + 1)])
    between = between - np.outer(total, total) / groups
    bb = np.linalg.solve(between[1:, 1:], between[1:, 0])
    sigma_u = max(0.0, float(between[0, 0] - bb @ between[1:, 0]) / (groups - k - 1) - sigma_e * one["h"] / groups)
    # quasi-demeaned products: x'x = p - t (2 theta - theta^2) m m', and the constant is 1 - theta
    keep = F.sqrt(F.lit(sigma_e) / (t * sigma_u + sigma_e))  # 1 - theta
    cells = [F.sum(F.col(f"p{i}_{j}") - t * (1 - keep * keep) * mean[i] * mean[j]).alias(f"p{i}_{j}") for i, j in pairs]
    sums = g.agg(F.sum(t * keep * keep).alias("c"), *(F.sum(keep * keep * F.col(f"s{i}")).alias(f"c{i}") for i in range(k + 1)), *cells).first()
    xx = np.zeros((k + 1, k + 1))
    xx[0, 0] = sums["c"]
    xx[0, 1:] = xx[1:, 0] = [sums[f"c{i}"] for i in range(1, k + 1)]
    xx[1:, 1:] = [[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(1, k + 1)] for i in range(1, k + 1)]
    xy = np.array([sums["c0"], *(sums[f"p0_{i}"] for i in range(1, k + 1))])
    inv = np.linalg.inv(xx)
    beta = inv @ xy
    rss = float(sums["p0_0"] - xy @ beta)
    dof = n - k - 1
    back = np.eye(k + 1)
    shift = np.array([centre[f"m{i}"] for i in range(k + 1)])
    back[0, 1:] = -shift[1:]
    beta, cov = back @ beta, back @ (inv * rss / dof) @ back.T
    beta[0] += shift[0]
    return Fit([ONE, *x], beta, cov, n, dof, rss, float("nan"), "random_effects", {"sigma_u": sigma_u**0.5, "sigma_e": sigma_e**0.5, "n_groups": groups})


def hausman(fixed: Fit, random: Fit) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p-value."""
    names = [v for v in fixed.names if v in random.names]
    i, j = [fixed.names.index(v) for v in names], [random.names.index(v) for v in names]
    d = fixed.coef[i] - random.coef[j]
    v = fixed.vcov[np.ix_(i, i)] - random.vcov[np.ix_(j, j)]
    stat = float(d @ np.linalg.pinv(v) @ d)
    return stat, len(names), special.chi2_upper(stat, len(names))
