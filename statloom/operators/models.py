"""More estimators on sufficient statistics: penalised paths, high-dimensional effects, survival and series models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from . import moments
from .moments import ONE, Fit, demeaned, no_nulls, ols, products
from .ordering import INDEX, indexed, ranged, running_all
from .survival import labels


def _standard(df: DataFrame, y: str, x: list[str]):
    s = products(df, [F.lit(1.0), *(F.col(c).cast("double") for c in [y, *x])])
    n = s[0, 0]
    mean = s[0, 1:] / n
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return n, mean, sd, cov / np.outer(sd, sd)


def elastic_net(df: DataFrame, y: str, x: list[str], penalties: list[float], mix: float = 1.0, rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """Path of coefficients (penalty, term, estimate) by coordinate descent on the correlation matrix: one pass over the rows, whatever the path's length."""
    no_nulls(df, [y, *x])
    n, mean, sd, r = _standard(df, y, x)
    xx, xy, b, out = r[1:, 1:], r[1:, 0], np.zeros(len(x)), []
    for lam in sorted(penalties, reverse=True):
        scaled = lam / sd[0]
        for _ in range(rounds):
            old = b.copy()
            for j in range(len(x)):
                z = xy[j] - xx[j] @ b + b[j]
                b[j] = np.sign(z) * max(abs(z) - scaled * mix, 0) / (1 + scaled * (1 - mix))
            if np.abs(b - old).max() < tolerance:
                break
        else:
            raise RuntimeError(f"not converged after {rounds} rounds")
        coef = b * sd[0] / sd[1:]
        out += [(float(lam), ONE, float(mean[0] - coef @ mean[1:])), *((float(lam), v, float(c)) for v, c in zip(x, coef, strict=True))]
    return df.sparkSession.createDataFrame(out, "penalty double, term string, estimate double")


def hdfe(df: DataFrame, y: str, x: list[str], effects: list[str], rounds: int = 200, tolerance: float = 1e-8, scratch=None) -> Fit:
    """Several fixed effects by alternating demeaning; stops when the coefficients settle. Each round is one grouped mean and join per effect."""
    no_nulls(df, [y, *x, *effects])
    rows = df.select(*dict.fromkeys([y, *x, *effects])).withColumns({c: F.col(c).cast("double") for c in [y, *x]})
    last = None
    shared, held = df.sparkSession.conf.get("spark.checkpoint.dir", None), None
    for k in range(rounds):
        for e in effects:
            rows = demeaned(rows, [y, *x], e)
        if shared:
            rows = rows.checkpoint()  # cuts the lineage in the folder that executors share
        else:
            rows = rows.persist()
        s = products(rows, [F.col(c) for c in [y, *x]])
        if held is not None:
            held.unpersist()
        held = rows
        b = np.linalg.solve(s[1:, 1:], s[1:, 0])
        if last is not None and np.abs(b - last).max() <= tolerance * max(1.0, np.abs(b).max()) or len(effects) == 1:
            break
        last = b
    else:
        raise RuntimeError(f"not converged after {rounds} rounds")
    n = df.count()
    groups = [df.select(e).distinct().count() for e in effects]
    dof = n - len(x) - sum(groups) + len(effects) - 1
    rss = float(s[0, 0] - b @ s[1:, 0])
    return Fit(list(x), b, np.linalg.inv(s[1:, 1:]) * rss / dof, n, dof, rss, float(s[0, 0]), "hdfe", {"rounds": k + 1})


def quantile_regression(df: DataFrame, y: str, x: list[str], tau: float = 0.5, rounds: int = 100, tolerance: float = 1e-8) -> Fit:
    """Quantile regression by iteratively reweighted least squares on the check function; a pass per round."""
    no_nulls(df, [y, *x])
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    target = F.col(y).cast("double")
    fit = ols(df, y, x)
    b = fit.coef
    scale = (fit.rss / fit.df) ** 0.5
    for k in range(rounds):
        e = target - sum((float(v) * c for v, c in zip(b, cols, strict=True)), F.lit(0.0))
        w = F.when(e >= 0, F.lit(tau)).otherwise(F.lit(1 - tau)) / F.greatest(F.abs(e), F.lit(scale * max(1e-6, 0.5**k)))
        s = products(df, [target, *cols], w)
        new = np.linalg.solve(s[1:, 1:], s[1:, 0])
        done = np.abs(new - b).max() < tolerance * max(1.0, np.abs(b).max())
        b = new
        if done and k > 20:
            break
    k = len(b)
    return Fit([ONE, *x], b, np.full((k, k), np.nan), fit.n, fit.df, kind="quantile")


def wald(fit: Fit, terms: list[str]) -> tuple[float, int, float]:
    """Joint test that the terms' coefficients are zero: statistic, degrees of freedom, p-value."""
    at = [fit.names.index(t) for t in terms]
    b, v = fit.coef[at], fit.vcov[np.ix_(at, at)]
    f = float(b @ np.linalg.solve(v, b)) / len(at)
    return f, len(at), special.f_upper(f, len(at), fit.df)


def residuals(df: DataFrame, fit: Fit, y: str, name: str = "residual") -> DataFrame:
    z = sum((float(b) * (F.lit(1.0) if t == ONE else F.col(t).cast("double")) for t, b in zip(fit.names, fit.coef, strict=True)), F.lit(0.0))
    return df.withColumn("fitted", z).withColumn(name, F.col(y).cast("double") - z)


def breusch_pagan(df: DataFrame, y: str, x: list[str]) -> tuple[float, int, float]:
    """Studentised test of heteroscedasticity: n times R2 of squared residuals on the regressors."""
    rows = residuals(df, ols(df, y, x), y).withColumn("__e2", F.col("residual") ** 2)
    aux = ols(rows, "__e2", x)
    stat = aux.n * aux.r2
    return stat, len(x), special.chi2_upper(stat, len(x))


def reset(df: DataFrame, y: str, x: list[str], powers: tuple[int, ...] = (2, 3)) -> tuple[float, int, int, float]:
    """Ramsey's test: do powers of the fitted values add to the fit?"""
    fit = ols(df, y, x)
    rows = residuals(df, fit, y)
    m, s = rows.agg(F.avg("fitted"), F.stddev_samp("fitted")).first()
    rows = rows.withColumns({f"__p{p}": ((F.col("fitted") - m) / s) ** p for p in powers})
    full = ols(rows, y, [*x, *(f"__p{p}" for p in powers)])
    f = (fit.rss - full.rss) / len(powers) / (full.rss / full.df)
    return f, len(powers), full.df, special.f_upper(f, len(powers), full.df)


def vif(df: DataFrame, x: list[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    _, _, _, r = _standard(df, x[0], x[1:]) if len(x) > 1 else (0, 0, 0, np.eye(1))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(x, np.diag(np.linalg.inv(r)), strict=True)], "term string, vif double")


def mean_group(df: DataFrame, y: str, x: str, entity: str) -> DataFrame:
    """A slope and intercept per entity (closed form in one aggregate), for pooled mean-group and varying-coefficient models."""
    g = df.groupBy(entity).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"), F.count("*").alias("n"))
    return g


def first_difference(df: DataFrame, y: str, x: list[str], entity: str, time: list[str]) -> Fit:
    """Least squares of within-entity differences."""
    w = Window.partitionBy(entity).orderBy(*time)
    rows = df.select(entity, *((F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(w)).alias(c) for c in [y, *x])).dropna()
    return ols(rows, y, x, intercept=False)


def att_gt(df: DataFrame, y: str, unit: str, time: str, first_treated: str) -> DataFrame:
    """Staggered adoption: for each cohort and period the change since the period before adoption, less that of the never treated (null first period)."""
    rows = df.select(F.col(unit).alias("u"), F.col(time).cast("int").alias("t"), F.col(first_treated).cast("int").alias("g"), F.col(y).cast("double").alias("y"))
    cohorts = rows.select("g").where("g is not null").distinct().withColumn("base", F.col("g") - 1)
    means = rows.groupBy("g", "t").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    own = means.where("g is not null").join(cohorts, "g")
    at_base = means.where("g is not null").select("g", F.col("t").alias("base"), F.col("m").alias("m0"))
    never = means.where("g is null").select("t", F.col("m").alias("c"))
    base_never = never.select(F.col("t").alias("base"), F.col("c").alias("c0"))
    out = own.join(at_base, ["g", "base"]).join(never, "t").join(base_never, "base")
    return out.select("g", "t", ((F.col("m") - F.col("m0")) - (F.col("c") - F.col("c0"))).alias("att"), "n")


def sargan(df: DataFrame, y: str, exogenous: list[str], endogenous: list[str], instruments: list[str]) -> tuple[float, int, float]:
    """Overidentification: n times R2 of the residuals on all instruments."""
    rows = residuals(df, moments.iv_2sls(df, y, exogenous, endogenous, instruments), y, "__e")
    aux = ols(rows, "__e", [*exogenous, *instruments])
    dof = len(instruments) - len(endogenous)
    stat = aux.n * aux.r2
    return stat, dof, special.chi2_upper(stat, dof) if dof else float("nan")


def first_stage(df: DataFrame, endogenous: str, instruments: list[str], controls: list[str] = ()) -> tuple[float, float]:
    """F statistic of the excluded instruments and its p-value."""
    fit = ols(df, endogenous, [*controls, *instruments])
    f, _, p = wald(fit, list(instruments))
    return f, p


def cox(df: DataFrame, time: str, event: str, x: list[str], steps: int = 30, tolerance: float = 1e-9) -> Fit:
    """Cox model (Breslow ties) by Newton's method.

    A step sums risk scores per distinct time, turns them into risk-set sums
    with ranged running totals, and adds up score and information.
    """
    no_nulls(df, [time, event, *x])
    k = len(x)
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(x)), F.count("*").alias("n")).first()
    cols = [F.col(c).cast("double") - means[f"m{i}"] for i, c in enumerate(x)]
    b = np.zeros(k)
    for _ in range(steps):
        risk = F.exp(sum((float(v) * c for v, c in zip(b, cols, strict=True)), F.lit(0.0)))
        e = F.col(event).cast("double")
        sums = {"r": risk, **{f"r{i}": risk * cols[i] for i in range(k)}, **{f"q{i}_{j}": risk * cols[i] * cols[j] for i in range(k) for j in range(i, k)}}
        by = df.groupBy(F.col(time).cast("double").alias("time")).agg(F.sum(e).alias("d"), *(F.sum(e * cols[i]).alias(f"x{i}") for i in range(k)), *(F.sum(v).alias(n) for n, v in sums.items()))
        by = running_all(ranged(by, ["time"]), {f"c_{name}": F.col(name) for name in sums}, ["time"], reverse=True)
        at = by.where("d > 0")
        mean = [F.col(f"c_r{i}") / F.col("c_r") for i in range(k)]
        row = at.agg(*(F.sum(F.col(f"x{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(k)), *(F.sum(F.col("d") * (F.col(f"c_q{i}_{j}") / F.col("c_r") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
        g = np.array([row[f"g{i}"] for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < tolerance:
            break
    else:
        raise RuntimeError(f"not converged after {steps} steps")
    return Fit(list(x), b, np.linalg.inv(h), means["n"], means["n"] - k, kind="cox")


def cumulative_incidence(df: DataFrame, time: str, cause: str) -> DataFrame:
    """Competing risks (cause 0 is censoring): (time, cause, incidence), Aalen-Johansen."""
    rows = df.select(F.col(time).cast("double").alias("time"), F.col(cause).cast("int").alias("cause")).where("time >= 0 and cause is not null")
    causes = labels(rows.where("cause > 0"), "cause")
    counts = [F.count_if(F.col("cause") == c).alias(f"k{i}") for i, c in enumerate(causes)]
    by = ranged(rows.groupBy("time").agg(F.count("*").alias("n"), F.count_if(F.col("cause") > 0).alias("d"), *counts), ["time"])
    by = running_all(by, {"r": F.col("n")}, ["time"], reverse=True).withColumn("q", F.ln(F.greatest(1 - F.col("d") / F.col("r"), F.lit(1e-300))))
    by = running_all(by, {"s": F.col("q")}, ["time"]).withColumn("before", F.exp(F.col("s") - F.col("q")))
    by = running_all(by, {f"c{i}": F.col("before") * F.col(f"k{i}") / F.col("r") for i in range(len(causes))}, ["time"])
    each = F.array(*(F.struct(F.lit(c).alias("cause"), F.col(f"c{i}").alias("incidence")) for i, c in enumerate(causes)))
    return by.select("time", F.inline(each)) if causes else by.select("time", F.lit(None).cast("int").alias("cause"), F.lit(None).cast("double").alias("incidence")).limit(0)


def var(df: DataFrame, columns: list[str], order_by: list[str], lags: int = 1) -> dict[str, Fit]:
    """Vector autoregression, an equation per column; lags come from places in the order, joined by windows over spans."""
    from .series import SPAN

    rows = indexed(df.select(*dict.fromkeys([*columns, *order_by])), order_by)
    span = max(SPAN, lags)
    at = F.col(INDEX)
    rows = rows.withColumn("__home", F.floor(at / span)).withColumn("__block", F.explode(F.array_distinct(F.array(F.floor(at / span), F.floor((at + lags) / span)))))
    w = Window.partitionBy("__block").orderBy(INDEX)
    rows = rows.withColumns({f"{c}_l{k}": F.lag(F.col(c).cast("double"), k).over(w) for c in columns for k in range(1, lags + 1)})
    rows = rows.where((F.col("__home") == F.col("__block")) & (at >= lags))
    x = [f"{c}_l{k}" for k in range(1, lags + 1) for c in columns]
    return {c: ols(rows, c, x) for c in columns}


def granger(df: DataFrame, cause: str, effect: str, order_by: list[str], lags: int = 1) -> tuple[float, int, float]:
    """Do lags of ``cause`` help to predict ``effect``?"""
    fit = var(df, [effect, cause], order_by, lags)[effect]
    return wald(fit, [f"{cause}_l{k}" for k in range(1, lags + 1)])


def holt_winters(df: DataFrame, value: str, order_by: list[str], series_id: list[str], period: int = 1, horizon: int = 4) -> DataFrame:
    """Additive exponential smoothing, one series per group; parameters by a grid, series by series.

    A series is ordered and small by nature; groups run side by side.
    """
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in series_id) + ", step int, forecast double, alpha double, beta double, gamma double, sse double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order_by)[value].astype(float).to_numpy()
        best = None
        seasonal = period > 1 and len(x) >= 2 * period
        for alpha in (0.1, 0.3, 0.5, 0.7, 0.9):
            for beta in (0.0, 0.1, 0.3):
                for gamma in (0.1, 0.3, 0.5) if seasonal else (0.0,):
                    level, trend = x[0], x[1] - x[0] if len(x) > 1 else 0.0
                    season = list(x[:period] - x[:period].mean()) if seasonal else [0.0]
                    if seasonal:
                        level, trend = x[:period].mean(), (x[period : 2 * period].mean() - x[:period].mean()) / period
                    sse = 0.0
                    for t in range(period if seasonal else 1, len(x)):
                        s = season[t % len(season)]
                        sse += (x[t] - level - trend - s) ** 2
                        before = level
                        level = alpha * (x[t] - s) + (1 - alpha) * (level + trend)
                        trend = beta * (level - before) + (1 - beta) * trend
                        if seasonal:
                            season[t % period] = gamma * (x[t] - level) + (1 - gamma) * s
                    if best is None or sse < best[0]:
                        best = sse, alpha, beta, gamma, level, trend, list(season)
        sse, alpha, beta, gamma, level, trend, season = best
        out = pd.DataFrame({"step": range(1, horizon + 1)})
        for c in reversed(series_id):
            out.insert(0, c, pdf[c].iloc[0])
        out["forecast"] = [level + k * trend + season[(len(x) + k - 1) % len(season)] for k in range(1, horizon + 1)]
        return out.assign(alpha=alpha, beta=beta, gamma=gamma, sse=sse).astype({"step": "int32"})

    return df.groupBy(*series_id).applyInPandas(run, schema)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal-width bins, the last one closed."""
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    width = (high - low) / bins or 1.0
    b = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, share of rows at or below it)."""
    from .ranks import value_ranks

    n = df.where(F.col(column).isNotNull()).count()
    return value_ranks(df, column).select(F.col(column).alias("value"), ((F.col("below") + F.col("n")) / n).alias("share"))


def two_way_anova(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Balanced two-way analysis of variance with interaction: (source, ss, df, statistic)."""
    v = F.col(y).cast("double")
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b"), v.alias("y")).dropna()
    grand, n, total = rows.agg(F.avg("y"), F.count("*"), F.var_pop("y") * F.count("*")).first()
    between = lambda *k: rows.groupBy(*k).agg(F.avg("y").alias("m"), F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("m") - grand) ** 2), F.count("*")).first()
    (sa, ka), (sb, kb), (sab, kab) = between("a"), between("b"), between("a", "b")
    parts = [("a", sa, ka - 1), ("b", sb, kb - 1), ("a:b", sab - sa - sb, (ka - 1) * (kb - 1))]
    sse, dfe = total - sab, n - kab
    out = [(s, float(ss), d, float(ss / d / (sse / dfe)), special.f_upper(ss / d / (sse / dfe), d, dfe)) for s, ss, d in parts]
    return df.sparkSession.createDataFrame([*out, ("error", float(sse), dfe, None, None)], "source string, ss double, df long, statistic double, p_value double")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a two-by-two table."""
    from math import exp, lgamma

    n, r, k = a + b + c + d, a + b, a + c
    log = lambda x, y: lgamma(x + 1) - lgamma(y + 1) - lgamma(x - y + 1)
    p = lambda i: exp(log(k, i) + log(n - k, r - i) - log(n, r))
    here = p(a)
    return min(1.0, sum(q for q in (p(i) for i in range(max(0, r + k - n), min(r, k) + 1)) if q <= here * (1 + 1e-7)))


def power_t(n: float, delta: float, sd: float = 1.0, level: float = 0.05) -> float:
    """Power of the two-sample t test (normal approximation of the noncentral tail)."""
    critical = special.t_critical(2 * n - 2, 1 - level)
    shift = delta / sd * (n / 2) ** 0.5
    return special.normal_cdf(shift - critical) + special.normal_cdf(-shift - critical)


def e_value(ratio: float) -> float:
    """How strong an unmeasured confounder must be to explain a risk ratio away."""
    r = max(ratio, 1 / ratio)
    return r + (r * (r - 1)) ** 0.5


def moran(points: DataFrame, id_col: str, x: str, y: str, value: str, radius: float) -> DataFrame:
    """Moran's I with row-standardised weights of neighbours within a radius: a grid join of neighbouring cells."""
    rows = points.select(F.col(id_col).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v")).dropna()
    mean = rows.agg(F.avg("v")).first()[0]
    rows = rows.withColumn("v", F.col("v") - mean).withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    near = F.array(*(F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    left = rows.select("i", "x", "y", "v", F.explode(near).alias("c")).select("i", "x", "y", "v", "c.cx", "c.cy")
    right = rows.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("v").alias("vj"), "cx", "cy")
    pairs = left.join(right, ["cx", "cy"]).where((F.col("i") != F.col("j")) & ((F.col("x") - F.col("xj")) ** 2 + (F.col("y") - F.col("yj")) ** 2 <= radius * radius))
    lagged = pairs.groupBy("i").agg(F.avg("vj").alias("w"), F.first("v").alias("v"))
    s = lagged.agg(F.sum(F.col("v") * F.col("w")).alias("a"), F.count("*").alias("k"))
    return s.crossJoin(rows.agg(F.sum(F.col("v") ** 2).alias("b"), F.count("*").alias("n"))).select((F.col("n") / F.col("k") * F.col("a") / F.col("b")).alias("moran_i"), "n", F.col("k").alias("with_neighbours"))  # one row each


def generate(spark, n: int, columns: dict[str, tuple], seed: int = 0) -> DataFrame:
    """Synthetic rows: name -> ("normal", mean, sd), ("uniform", low, high), ("integer", low, high) or ("choice", values)."""
    makers = {
        "normal": lambda s, a, b: F.randn(s) * b + a,
        "uniform": lambda s, a, b: F.rand(s) * (b - a) + a,
        "integer": lambda s, a, b: F.floor(F.rand(s) * (b - a + 1) + a).cast("long"),
        "choice": lambda s, v: F.element_at(F.array(*(F.lit(c) for c in v)), (F.floor(F.rand(s) * len(v)) + 1).cast("int")),
    }
    return spark.range(n).select("id", *(makers[k](seed + i, *rest).alias(c) for i, (c, (k, *rest)) in enumerate(columns.items())))
