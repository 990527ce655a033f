"""Maximum likelihood with the log-likelihood of a row as a column expression.

Score and information come from central differences of that expression, all in
one aggregate per Newton step: a row meets each point of the differences (1 + 2k +
k(k - 1) of them, sent to all tasks) and is summed in place; rows never leave the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .moments import ONE, Fit, _normal_cdf, glm, no_nulls, ols
from .survival import labels

TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive column: Stirling's series after eight steps up, error about 1e-12."""
    up, shift = x + 8, F.lit(0.0)
    for k in range(8):
        shift = shift + F.ln(x + k)
    r = 1 / up
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + r / 12 - r * r * r / 360 + r * r * r * r * r / 1260 - r * r * r * r * r * r * r / 1680 - shift


def maximize(df: DataFrame, loglik: Callable[[list[Column]], Column], start: list[float], names: list[str], steps: int = 60, tolerance: float = 1e-7, kind: str = "likelihood") -> Fit:
    """Newton's method with halved steps; variances from the inverse information."""
    k, h = len(start), 1e-4
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    theta = np.array(start, float)

    # the expression is built once; a pass joins the rows with the stated points (one per difference) and sums per point
    told = loglik([F.col(f"__t{i}") for i in range(k)])
    moves = [{}, *({i: d * h} for i in range(k) for d in (-1, 1)), *({i: d * h, j: d * h} for i, j in pairs for d in (-1, 1))]
    schema = "__s int, " + ", ".join(f"__t{i} double" for i in range(k))

    def measured() -> tuple[float, np.ndarray, np.ndarray, int]:
        at = df.sparkSession.createDataFrame([(s, *(float(theta[i] + m.get(i, 0.0)) for i in range(k))) for s, m in enumerate(moves)], schema)
        got = {r["__s"]: r for r in df.crossJoin(F.broadcast(at)).groupBy("__s").agg(F.sum(told).alias("l"), F.count("*").alias("n")).collect()}  # a row per point
        if not got:
            raise ValueError("no rows")
        ll = [got[s]["l"] if got[s]["l"] is not None else float("nan") for s in range(len(moves))]
        grad = np.array([(ll[2 * i + 2] - ll[2 * i + 1]) / (2 * h) for i in range(k)])
        hess = np.diag([(ll[2 * i + 2] - 2 * ll[0] + ll[2 * i + 1]) / h**2 for i in range(k)])
        for c, (i, j) in enumerate(pairs):
            both = ll[2 * k + 2 * c + 1] + ll[2 * k + 2 * c + 2]
            cross = both - ll[2 * i + 1] - ll[2 * i + 2] - ll[2 * j + 1] - ll[2 * j + 2] + 2 * ll[0]
            hess[i, j] = hess[j, i] = cross / (2 * h**2)
        return ll[0], grad, hess, got[0]["n"]

    best, grad, hess, n = measured()
    for _ in range(steps):
        values, vectors = np.linalg.eigh(-hess)
        values = np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max()))
        step = vectors @ ((vectors.T @ grad) / values)
        size = float(np.abs(step).max())
        step = step if size <= 5 else step * (5 / size)
        origin, scale = theta, 1.0
        while True:
            theta = origin + scale * step
            now = measured()
            if np.isfinite(now[0]) and np.isfinite(now[2]).all() and now[0] >= best - 1e-9 * abs(best) or scale < 1e-4:
                break
            scale /= 2
        gain = now[0] - best
        best, grad, hess, n = now
        if np.abs(scale * step).max() < tolerance * max(1.0, np.abs(theta).max()) or (0 <= gain < 1e-11 * abs(best) and scale == 1.0):
            break
    else:
        raise RuntimeError(f"not converged after {steps} steps")
    return Fit(names, theta, np.linalg.pinv(-hess), n, n - k, kind=kind, extra={"log_likelihood": best, "aic": 2 * k - 2 * best, "bic": k * math.log(n) - 2 * best})


def _linear(theta: list[Column], x: list[str], first: int = 0, intercept: bool = True) -> Column:
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in x)] if intercept else [F.col(c).cast("double") for c in x]
    return sum((theta[first + i] * t for i, t in enumerate(terms)), F.lit(0.0))


def negative_binomial(df: DataFrame, y: str, x: list[str]) -> Fit:
    """Counts with variance mu + alpha mu^2; the last parameter is ln(alpha)."""
    no_nulls(df, [y, *x])
    v, k = F.col(y).cast("double"), len(x) + 1

    def ll(t):
        size, z = F.exp(-t[k]), _linear(t, x)
        mu = F.exp(z)
        return log_gamma(v + size) - log_gamma(size) - log_gamma(v + 1) + size * (F.ln(size) - F.ln(size + mu)) + v * (z - F.ln(size + mu))

    return maximize(df, ll, [*glm(df, y, x, "poisson").coef, -1.0], [ONE, *x, "ln_alpha"], kind="negative_binomial")


def _poisson(v: Column, z: Column) -> Column:
    return v * z - F.exp(z) - log_gamma(v + 1)


def zero_inflated(df: DataFrame, y: str, x: list[str], inflate: list[str], family: str = "poisson") -> Fit:
    """Counts with extra zeros of logit probability: Poisson or negative binomial; parameters of the zeros are named zero_*."""
    no_nulls(df, [y, *x, *inflate])
    v, k, m = F.col(y).cast("double"), len(x) + 1, len(inflate) + 1

    def ll(t):
        z, g = _linear(t, x), _linear(t, inflate, k)
        p = 1 / (1 + F.exp(-g))
        if family == "poisson":
            zero, some = F.exp(-F.exp(z)), _poisson(v, z)
        else:
            size = F.exp(-t[k + m])
            mu = F.exp(z)
            zero = F.exp(size * (F.ln(size) - F.ln(size + mu)))
            some = log_gamma(v + size) - log_gamma(size) - log_gamma(v + 1) + size * (F.ln(size) - F.ln(size + mu)) + v * (z - F.ln(size + mu))
        return F.when(v == 0, F.ln(p + (1 - p) * zero)).otherwise(F.ln(1 - p) + some)

    start = [*glm(df, y, x, "poisson").coef, *([-0.5] + [0.0] * (m - 1)), *([-0.5] if family != "poisson" else [])]
    return maximize(df, ll, start, [ONE, *x, *(f"zero_{c}" for c in [ONE, *inflate]), *(["ln_alpha"] if family != "poisson" else [])], kind=f"zero_inflated_{family}")


def hurdle(df: DataFrame, y: str, x: list[str], zero: list[str] | None = None) -> tuple[Fit, Fit]:
    """A logit for any count and a Poisson cut at zero for the positive ones."""
    zero = x if zero is None else zero
    no_nulls(df, [y, *x, *zero])
    some = glm(df.withColumn("__some", (F.col(y) > 0).cast("int")), "__some", zero, "logit")
    positive, v = df.where(F.col(y) > 0), F.col(y).cast("double")

    def ll(t):
        z = _linear(t, x)
        return _poisson(v, z) - F.ln(-F.expm1(-F.exp(z)))

    return some, maximize(positive, ll, list(glm(positive, y, x, "poisson").coef), [ONE, *x], kind="hurdle")


def ordered(df: DataFrame, y: str, x: list[str], link: str = "logit") -> Fit:
    """Ordered logit or probit: coefficients, then the cuts as their first value and the logs of the steps."""
    no_nulls(df, [y, *x])
    levels = labels(df, y)
    k, m = len(x), len(levels)
    cdf = (lambda z: 1 / (1 + F.exp(-z))) if link == "logit" else _normal_cdf
    place = F.create_map(*(F.lit(v) for i, g in enumerate(levels) for v in (g, i)))[F.col(y)]

    def ll(t):
        z = _linear(t, x, 0, False)
        cuts = [t[k]]
        for i in range(1, m - 1):
            cuts.append(cuts[-1] + F.exp(t[k + i]))
        below = [F.lit(0.0), *(cdf(c - z) for c in cuts), F.lit(1.0)]
        p = F.lit(0.0)
        for i in range(m):
            p = F.when(place == i, below[i + 1] - below[i]).otherwise(p)
        return F.ln(F.greatest(p, F.lit(TINY)))

    n = df.count()
    share = np.cumsum([df.where(F.col(y) == F.lit(g)).count() / n for g in levels])[:-1]
    cut = [math.log(s / (1 - s)) if link == "logit" else special.normal_quantile(s) for s in share]
    start = [0.0] * k + [cut[0], *(math.log(max(b - a, 1e-3)) for a, b in zip(cut, cut[1:], strict=False))]
    fit = maximize(df, ll, start, [*x, "cut1", *(f"ln_step{i}" for i in range(2, m))], kind=f"ordered_{link}")
    cuts = [fit.coef[k]]
    for i in range(1, m - 1):
        cuts.append(cuts[-1] + math.exp(fit.coef[k + i]))
    fit.extra["cuts"] = [float(c) for c in cuts]
    return fit


def multinomial(df: DataFrame, y: str, x: list[str]) -> Fit:
    """Multinomial logit against the first level; parameters are named level:term. Analytic score and information, one aggregate a step."""
    no_nulls(df, [y, *x])
    levels = labels(df, y)
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    k, m = len(cols), len(levels) - 1
    beta, n = np.zeros((m, k)), 0
    for _ in range(60):
        e = [F.exp(F.least(sum((float(b) * c for b, c in zip(beta[i], cols, strict=True)), F.lit(0.0)), F.lit(500.0))) for i in range(m)]
        work = df.select(F.col(y).alias("__y"), *(c.alias(f"__x{i}") for i, c in enumerate(cols)), *(v.alias(f"__e{i}") for i, v in enumerate(e)))
        total = sum((F.col(f"__e{i}") for i in range(m)), F.lit(1.0))
        work = work.withColumns({f"__p{i}": F.col(f"__e{i}") / total for i in range(m)})
        hit = [(F.col("__y") == F.lit(levels[i + 1])).cast("double") for i in range(m)]
        p, z = [F.col(f"__p{i}") for i in range(m)], [F.col(f"__x{i}") for i in range(k)]
        own = F.lit(0.0) + F.when(F.col("__y") == F.lit(levels[0]), 1 - sum(p, F.lit(0.0))).otherwise(sum((hit[i] * p[i] for i in range(m)), F.lit(0.0)))
        cells = [F.sum((hit[i] - p[i]) * z[a]).alias(f"g{i}_{a}") for i in range(m) for a in range(k)]
        cells += [F.sum(p[i] * ((1.0 if i == j else 0.0) - p[j]) * z[a] * z[b]).alias(f"h{i}_{j}_{a}_{b}") for i in range(m) for j in range(i, m) for a in range(k) for b in range(a, k)]
        row = work.agg(*cells, F.sum(F.ln(F.greatest(own, F.lit(TINY)))).alias("l"), F.count("*").alias("n")).first()
        grad = np.array([row[f"g{i}_{a}"] for i in range(m) for a in range(k)])
        info = np.array([[row[f"h{min(i, j)}_{max(i, j)}_{min(a, b)}_{max(a, b)}"] for j in range(m) for b in range(k)] for i in range(m) for a in range(k)])
        step = np.linalg.solve(info, grad)
        beta, n = beta + step.reshape(m, k), row["n"]
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(beta).max()):
            break
    else:
        raise RuntimeError("not converged after 60 steps")
    names = [f"{levels[i + 1]}:{t}" for i in range(m) for t in [ONE, *x]]
    return Fit(names, beta.ravel(), np.linalg.inv(info), n, n - m * k, kind="multinomial", extra={"log_likelihood": row["l"], "levels": levels})


def conditional(df: DataFrame, choice: str, x: list[str], set_id: str, steps: int = 60) -> Fit:
    """Conditional (McFadden) logit: one chosen row per choice set. A step sums weights and products per set, then over sets."""
    no_nulls(df, [choice, set_id, *x])
    cols, k = [F.col(c).cast("double") for c in x], len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta = np.zeros(k)
    for _ in range(steps):
        e = F.exp(sum((float(b) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0)))
        chosen = F.col(choice).cast("double")
        g = df.groupBy(set_id).agg(F.sum(e).alias("w"), *(F.sum(e * c).alias(f"a{i}") for i, c in enumerate(cols)), *(F.sum(e * cols[i] * cols[j]).alias(f"q{i}_{j}") for i, j in pairs), *(F.sum(chosen * c).alias(f"c{i}") for i, c in enumerate(cols)), F.sum(chosen * F.ln(e)).alias("u"), F.sum(chosen).alias("hits"))
        mean = [F.col(f"a{i}") / F.col("w") for i in range(k)]
        row = g.where("hits = 1").agg(F.count("*").alias("n"), F.sum(F.col("u") - F.ln("w")).alias("l"), *(F.sum(F.col(f"c{i}") - mean[i]).alias(f"g{i}") for i in range(k)), *(F.sum(F.col(f"q{i}_{j}") / F.col("w") - mean[i] * mean[j]).alias(f"h{i}_{j}") for i, j in pairs)).first()
        grad = np.array([row[f"g{i}"] for i in range(k)])
        info = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(beta).max()):
            break
    else:
        raise RuntimeError(f"not converged after {steps} steps")
    return Fit(list(x), beta, np.linalg.inv(info), row["n"], row["n"] - k, kind="conditional", extra={"log_likelihood": row["l"]})


def accelerated_failure(df: DataFrame, time: str, event: str, x: list[str], distribution: str = "weibull") -> Fit:
    """Accelerated failure times, right-censored: weibull, exponential, lognormal or loglogistic; the last parameter is ln(scale)."""
    no_nulls(df, [time, event, *x])
    k = len(x) + 1
    rows = df.where(F.col(time) > 0)
    t_, d = F.ln(F.col(time).cast("double")), F.col(event).cast("double")

    def ll(theta):
        s = F.exp(theta[k]) if distribution != "exponential" else F.lit(1.0)
        w = (t_ - _linear(theta, x)) / s
        if distribution in ("weibull", "exponential"):
            dens, surv = w - F.exp(w), -F.exp(w)
        elif distribution == "lognormal":
            dens, surv = -0.5 * w * w - 0.5 * math.log(2 * math.pi), F.ln(F.greatest(_normal_cdf(-w), F.lit(TINY)))
        else:
            dens, surv = w - 2 * F.log1p(F.exp(w)), -F.log1p(F.exp(w))
        return d * (dens - F.ln(s) - t_) + (1 - d) * surv

    base = ols(rows.withColumn("__t", t_), "__t", x)
    start = [*base.coef, *([0.5 * math.log(max(base.rss / base.df, 1e-6))] if distribution != "exponential" else [])]
    return maximize(rows, ll, start, [ONE, *x, *(["ln_scale"] if distribution != "exponential" else [])], kind=f"aft_{distribution}")


def tobit(df: DataFrame, y: str, x: list[str], floor: float = 0.0) -> Fit:
    """Normal regression censored from below; the last parameter is ln(sigma)."""
    no_nulls(df, [y, *x])
    k, v = len(x) + 1, F.col(y).cast("double")

    def ll(t):
        s = F.exp(t[k])
        w = (v - _linear(t, x)) / s
        return F.when(v > floor, -0.5 * w * w - 0.5 * math.log(2 * math.pi) - F.ln(s)).otherwise(F.ln(F.greatest(_normal_cdf((floor - _linear(t, x)) / s), F.lit(TINY))))

    base = ols(df, y, x)
    return maximize(df, ll, [*base.coef, 0.5 * math.log(base.rss / base.df)], [ONE, *x, "ln_sigma"], kind="tobit")


def marginal_effects(df: DataFrame, fit: Fit, x: list[str]) -> DataFrame:
    """Average marginal effects of a logit, probit or Poisson fit, with errors by the delta method: one aggregate."""
    k = len(fit.names)

    def slope(beta: np.ndarray) -> Column:
        z = sum((float(b) * (F.lit(1.0) if n == ONE else F.col(n).cast("double")) for n, b in zip(fit.names, beta, strict=True)), F.lit(0.0))
        if fit.kind == "logit":
            p = 1 / (1 + F.exp(-z))
            return p * (1 - p)
        return F.exp(z) if fit.kind == "poisson" else F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)

    h = 1e-5
    shifted = [fit.coef + d * h * np.eye(k)[i] for i in range(k) for d in (-1, 1)]
    row = df.agg(F.avg(slope(fit.coef)).alias("m"), *(F.avg(slope(b)).alias(f"d{i}") for i, b in enumerate(shifted))).first()
    dm = np.array([(row[f"d{2 * i + 1}"] - row[f"d{2 * i}"]) / (2 * h) for i in range(k)])
    out = []
    for c in x:
        i = fit.names.index(c)
        grad = fit.coef[i] * dm
        grad[i] += row["m"]
        est, se = float(fit.coef[i] * row["m"]), float(math.sqrt(grad @ fit.vcov @ grad))
        out.append((c, est, se, est / se, special.normal_two_sided(est / se)))
    return df.sparkSession.createDataFrame(out, "term string, effect double, std_error double, statistic double, p_value double")
