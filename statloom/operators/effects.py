"""Treatment effects by matching, weighting, orthogonal scores, standardisation and designs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .causal import _score, rd_local_linear
from .moments import ONE, Fit, glm, no_nulls, ols, products
from .ordering import PART, ranged, running_all


def _linear(fit: Fit, fixed: dict[str, Column] | None = None) -> Column:
    fixed = fixed or {}
    value = lambda t: F.lit(1.0) if t == ONE else fixed[t] if t in fixed else F.col(t).cast("double")
    return sum((float(b) * value(t) for t, b in zip(fit.names, fit.coef, strict=True)), F.lit(0.0))


def _row(df: DataFrame, names: str, *values) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values)], names)


def nearest_match(df: DataFrame, y: str, treatment: str, covariates: list[str], caliper: float | None = None) -> DataFrame:
    """(effect, matched, treated): effect on the treated by the nearest propensity score with replacement (mean outcome where scores tie).

    Controls are summed per score; running maxima and minima over the ordered
    scores give each treated row its neighbours, so no pairs are formed.
    """
    p, d = _score(df, treatment, covariates, 1e-6), F.col(treatment).cast("int")
    rows = df.select(F.round(p, 12).alias("p"), d.alias("d"), F.col(y).cast("double").alias("y"))
    by = rows.groupBy("p").agg(F.sum("d").alias("nt"), F.sum(F.when(F.col("d") == 1, F.col("y"))).alias("yt"), F.avg(F.when(F.col("d") == 0, F.col("y"))).alias("yc"))
    by = by.withColumn("has", F.when(F.col("yc").isNotNull(), F.col("p")))
    placed = running_all(ranged(by, ["p"]), {"low": F.coalesce("has", F.lit(-1.0))}, ["p"], "max")
    placed = running_all(placed, {"high": F.coalesce("has", F.lit(2.0))}, ["p"], "min", True).drop(PART)
    lower = F.col("p") - F.col("low") <= F.col("high") - F.col("p")
    near = F.when((F.col("low") >= 0) & (lower | (F.col("high") > 1)), F.col("low")).otherwise(F.col("high"))
    treated = placed.where("nt > 0").withColumn("near", near).withColumn("gap", F.abs(F.col("p") - near))
    if caliper is not None:
        treated = treated.where(F.col("gap") <= caliper)
    other = by.where("has is not null").select(F.col("p").alias("near"), F.col("yc").alias("match"))
    s = treated.select("nt", "yt", "near").join(other, "near").agg((F.sum(F.col("yt") - F.col("nt") * F.col("match")) / F.sum("nt")).alias("effect"), F.sum("nt").alias("matched"))
    return s.crossJoin(rows.agg(F.sum("d").alias("treated")))  # one row each


def exact_cells(df: DataFrame, y: str, treatment: str, covariates: list[str], bins: int = 5) -> DataFrame:
    """(effect, matched, treated, cells): coarsened exact matching, effect on the treated in cells that hold both groups."""
    kinds, keys = dict(df.dtypes), []
    cuts = {c: sorted(set(df.agg(F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000)).first()[0] or [])) for c in covariates if kinds[c] not in ("string", "boolean")}
    for c in covariates:
        keys.append((sum((F.when(F.col(c) > float(v), 1).otherwise(0) for v in cuts[c]), F.lit(0)) if c in cuts else F.col(c)).alias(f"__{c}"))
    d, v = F.col(treatment) == 1, F.col(y).cast("double")
    cells = df.groupBy(*keys).agg(F.count_if(d).alias("nt"), F.count_if(~d).alias("nc"), F.avg(F.when(d, v)).alias("yt"), F.avg(F.when(~d, v)).alias("yc"))
    both = (F.col("nt") > 0) & (F.col("nc") > 0)
    return cells.agg((F.sum(F.when(both, F.col("nt") * (F.col("yt") - F.col("yc")))) / F.sum(F.when(both, F.col("nt")))).alias("effect"), F.sum(F.when(both, F.col("nt"))).alias("matched"), F.sum("nt").alias("treated"), F.count_if(both).alias("cells"))


def subclasses(df: DataFrame, y: str, treatment: str, covariates: list[str], classes: int = 5) -> DataFrame:
    """(subclass, n_treated, n_control, effect): differences of means within quantiles of the propensity score."""
    p = _score(df, treatment, covariates, 1e-6)
    rows = df.select(p.alias("p"), (F.col(treatment) == 1).alias("d"), F.col(y).cast("double").alias("y"))
    cuts = sorted(set(rows.agg(F.percentile_approx("p", [k / classes for k in range(1, classes)], 10_000)).first()[0] or []))
    k = sum((F.when(F.col("p") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return rows.groupBy(k.alias("subclass")).agg(F.count_if("d").alias("n_treated"), F.count_if(~F.col("d")).alias("n_control"), (F.avg(F.when(F.col("d"), F.col("y"))) - F.avg(F.when(~F.col("d"), F.col("y")))).alias("effect"))


def balance(df: DataFrame, treatment: str, covariates: list[str], weight: Column | None = None) -> DataFrame:
    """(term, difference, ratio): standardised mean differences and ratios of variances, weighted or not."""
    w, d = weight if weight is not None else F.lit(1.0), F.col(treatment) == 1
    cells = []
    for i, c in enumerate(covariates):
        v = F.col(c).cast("double")
        for k, keep in ((1, d), (0, ~d)):
            wk = F.when(keep, w).otherwise(0.0)
            cells += [(F.sum(wk * v) / F.sum(wk)).alias(f"m{i}_{k}"), (F.sum(wk * v * v) / F.sum(wk)).alias(f"q{i}_{k}"), F.var_samp(F.when(keep, v)).alias(f"v{i}_{k}")]
    r = df.agg(*cells).first()
    out = []
    for i, c in enumerate(covariates):
        var = [r[f"q{i}_{k}"] - r[f"m{i}_{k}"] ** 2 for k in (0, 1)]
        out.append((c, float((r[f"m{i}_1"] - r[f"m{i}_0"]) / math.sqrt((r[f"v{i}_1"] + r[f"v{i}_0"]) / 2)), float(var[1] / var[0]) if var[0] else None))
    return df.sparkSession.createDataFrame(out, "term string, difference double, ratio double")


def entropy_weights(df: DataFrame, treatment: str, covariates: list[str], steps: int = 100, tolerance: float = 1e-8) -> Column:
    """Weights of the controls that meet the treated rows' means exactly and are nearest to equal ones: Newton on the dual, an aggregate a step."""
    no_nulls(df, [treatment, *covariates])
    target = df.where(F.col(treatment) == 1).agg(*(F.avg(F.col(c).cast("double")) for c in covariates)).first()
    sd = df.agg(*(F.stddev_pop(F.col(c).cast("double")) for c in covariates)).first()
    z = [(F.col(c).cast("double") - float(t)) / float(s or 1.0) for c, t, s in zip(covariates, target, sd, strict=True)]
    control, lam, k = df.where(F.col(treatment) == 0), np.zeros(len(z)), len(z)
    for _ in range(steps):
        w = F.exp(F.least(sum((float(a) * c for a, c in zip(lam, z, strict=True)), F.lit(0.0)), F.lit(200.0)))
        s = products(control, [F.lit(1.0), *z], w)
        mean = s[0, 1:] / s[0, 0]
        if np.abs(mean).max() < tolerance:
            break
        cov = s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
        step = np.linalg.solve(cov + 1e-12 * np.eye(k), mean)
        lam = lam - step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
    else:
        raise RuntimeError(f"the treated means can't be met in {steps} steps")
    return F.when(F.col(treatment) == 1, 1.0).otherwise(F.exp(sum((float(a) * c for a, c in zip(lam, z, strict=True)), F.lit(0.0))))


def entropy_balance(df: DataFrame, y: str, treatment: str, covariates: list[str]) -> DataFrame:
    """(effect, std_error): effect on the treated with entropy-balanced controls."""
    return weighted_effect(df, y, treatment, entropy_weights(df, treatment, covariates))


def weighted_effect(df: DataFrame, y: str, treatment: str, weight: Column) -> DataFrame:
    """(effect, std_error): weighted difference of means with the linearised error."""
    v, d = F.col(y).cast("double"), F.col(treatment) == 1
    w = [F.when(d, weight).otherwise(0.0), F.when(~d, weight).otherwise(0.0)]
    m1, m0 = df.agg(*(F.sum(k * v) / F.sum(k) for k in w)).first()
    var = sum((F.sum((k * (v - float(m))) ** 2) / F.pow(F.sum(k), 2) for k, m in zip(w, (m1, m0), strict=True)), F.lit(0.0))
    se = math.sqrt(df.agg(var).first()[0])
    return _row(df, "effect double, std_error double, p_value double", float(m1 - m0), se, special.normal_two_sided((m1 - m0) / se))


def _folds(id_col: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(folds)).cast("int")


def double_ml(df: DataFrame, y: str, treatment: str, x: list[str], id_col: str, folds: int = 5) -> DataFrame:
    """(effect, std_error): partially linear model; outcome and treatment are predicted from the other folds' regressions, whose products come from one aggregate."""
    no_nulls(df, [y, treatment, *x])
    every = [F.col(y).cast("double"), F.col(treatment).cast("double"), F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    k = len(every)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = df.groupBy(_folds(id_col, folds).alias("f")).agg(*(F.sum(every[i] * every[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect()  # a row per fold
    parts = {r["f"]: np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in got}
    whole = sum(parts.values())
    ry, rd = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f, part in parts.items():
        s = whole - part
        b = np.linalg.solve(s[2:, 2:], s[2:, :2])
        at = lambda j, b=b: sum((float(v) * c for v, c in zip(b[:, j], every[2:], strict=True)), F.lit(0.0))
        here = _folds(id_col, folds) == f
        ry, rd = F.when(here, every[0] - at(0)).otherwise(ry), F.when(here, every[1] - at(1)).otherwise(rd)
    rows = df.select(ry.alias("u"), rd.alias("v"))
    n, uv, vv = rows.agg(F.count("*"), F.sum(F.col("u") * F.col("v")), F.sum(F.col("v") ** 2)).first()
    theta = uv / vv
    se = math.sqrt(rows.agg(F.sum((F.col("v") * (F.col("u") - theta * F.col("v"))) ** 2)).first()[0]) / vv
    return _row(df, "effect double, std_error double, p_value double, n long", theta, se, special.normal_two_sided(theta / se), n)


def standardized(df: DataFrame, y: str, treatment: str, covariates: list[str], family: str = "linear", interact: bool = True) -> DataFrame:
    """(treated, control, effect, ratio): outcome regressions averaged over all rows with the treatment set to 1 and to 0 (the g-formula)."""
    means = []
    for k in (1, 0):
        part = df.where(F.col(treatment) == k) if interact else df
        x = covariates if interact else [treatment, *covariates]
        fit = ols(part, y, x) if family == "linear" else glm(part, y, x, family)
        z = _linear(fit, {treatment: F.lit(float(k))})
        means.append(F.avg(z if family == "linear" else 1 / (1 + F.exp(-z)) if family == "logit" else F.exp(z)))
    s = df.agg(means[0].alias("treated"), means[1].alias("control"))
    return s.select("treated", "control", (F.col("treated") - F.col("control")).alias("effect"), (F.col("treated") / F.col("control")).alias("ratio"))


def tmle(df: DataFrame, y: str, treatment: str, covariates: list[str], trim: float = 0.01) -> DataFrame:
    """(effect, std_error): targeted maximum likelihood of the average effect; the outcome is scaled to 0..1 and fluctuated along the clever covariate."""
    low, high = df.agg(F.min(F.col(y).cast("double")), F.max(F.col(y).cast("double"))).first()
    wide = (high - low) or 1.0
    rows = df.withColumn("__y", F.greatest(F.least((F.col(y).cast("double") - low) / wide, F.lit(0.9995)), F.lit(0.0005)))
    d = F.col(treatment).cast("double")
    q = []
    for k in (1, 0):
        fit = ols(rows.where(F.col(treatment) == k), "__y", covariates)
        q.append(F.greatest(F.least(_linear(fit), F.lit(0.9995)), F.lit(0.0005)))
    p = _score(df, treatment, covariates, trim)
    rows = rows.select(F.col("__y").alias("y"), d.alias("d"), p.alias("p"), *(F.ln(v / (1 - v)).alias(f"q{k}") for k, v in zip((1, 0), q, strict=True)))
    h1, h0 = 1 / F.col("p"), -1 / (1 - F.col("p"))
    h, base, e = F.when(F.col("d") == 1, h1).otherwise(h0), F.when(F.col("d") == 1, F.col("q1")).otherwise(F.col("q0")), 0.0
    for _ in range(50):
        m = 1 / (1 + F.exp(-(base + e * h)))
        g, i = rows.agg(F.sum(h * (F.col("y") - m)), F.sum(h * h * m * (1 - m))).first()
        e += g / i
        if abs(g / i) < 1e-10:
            break
    m1, m0 = (1 / (1 + F.exp(-(F.col(f"q{k}") + e * v))) for k, v in ((1, h1), (0, h0)))
    own = F.when(F.col("d") == 1, m1).otherwise(m0)
    s = rows.agg(F.avg(m1 - m0), F.var_samp(h * (F.col("y") - own) + m1 - m0), F.count("*")).first()
    effect, se = s[0] * wide, math.sqrt(s[1] / s[2]) * wide
    return _row(df, "effect double, std_error double, p_value double", effect, se, special.normal_two_sided(effect / se))


def mediation(df: DataFrame, y: str, treatment: str, mediator: str, covariates: list[str] | None = None) -> DataFrame:
    """(path, effect, std_error): indirect, direct and total effects of linear models, errors by the delta method."""
    x = covariates or []
    a, b = ols(df, mediator, [treatment, *x]), ols(df, y, [treatment, mediator, *x])
    at = lambda f, t: (float(f.coef[f.names.index(t)]), float(f.se[f.names.index(t)]))
    (a1, sa), (b1, sb), (c1, sc) = at(a, treatment), at(b, mediator), at(b, treatment)
    cross = float(b.vcov[b.names.index(treatment), b.names.index(mediator)])
    indirect, se = a1 * b1, math.sqrt(a1 * a1 * sb * sb + b1 * b1 * sa * sa)
    total = math.sqrt(se * se + sc * sc + 2 * a1 * cross)
    return df.sparkSession.createDataFrame([("indirect", indirect, se), ("direct", c1, sc), ("total", indirect + c1, total), ("share", indirect / (indirect + c1), None)], "path string, effect double, std_error double")


def bacon(df: DataFrame, y: str, unit: str, time: str, first_treated: str) -> DataFrame:
    """(treated, control, kind, weight, estimate): the two-by-two comparisons that make up a two-way fixed effects estimate, from cohort and period means."""
    got = df.groupBy(F.col(first_treated).cast("int").alias("g"), F.col(time).cast("int").alias("t")).agg(F.avg(F.col(y).cast("double")).alias("m"), F.count_distinct(unit).alias("n")).collect()  # a row per cohort and period
    times = sorted({r["t"] for r in got})
    mean = {(r["g"], r["t"]): r["m"] for r in got}
    size = {}
    for r in got:
        size[r["g"]] = max(size.get(r["g"], 0), r["n"])
    n, span = sum(size.values()), len(times)
    avg = lambda g, keep: np.mean([mean[g, t] for t in times if keep(t)])
    cohorts, out = sorted(g for g in size if g is not None), []
    share = {g: sum(t >= g for t in times) / span for g in cohorts}
    for g in cohorts:
        if None in size and 0 < share[g] < 1:
            w = size[g] * size[None] / n**2 * share[g] * (1 - share[g])
            out.append((g, None, "never treated", w, (avg(g, lambda t, g=g: t >= g) - avg(g, lambda t, g=g: t < g)) - (avg(None, lambda t, g=g: t >= g) - avg(None, lambda t, g=g: t < g))))
    for i, e in enumerate(cohorts):
        for l in cohorts[i + 1 :]:
            if share[e] < 1 and share[e] > share[l]:
                w = size[e] * size[l] / n**2 * (share[e] - share[l]) * (1 - share[e])
                mid, pre = lambda t, e=e, l=l: e <= t < l, lambda t, e=e: t < e
                out.append((e, l, "earlier against later", w, (avg(e, mid) - avg(e, pre)) - (avg(l, mid) - avg(l, pre))))
            if share[l] > 0:
                w = size[e] * size[l] / n**2 * share[l] * (share[e] - share[l])
                post, mid = lambda t, l=l: t >= l, lambda t, e=e, l=l: e <= t < l
                out.append((l, e, "later against earlier", w, (avg(l, post) - avg(l, mid)) - (avg(e, post) - avg(e, mid))))
    total = sum(o[3] for o in out)
    return df.sparkSession.createDataFrame([(*o[:3], float(o[3] / total), float(o[4])) for o in out], "treated int, control int, kind string, weight double, estimate double")


def synthetic_control(df: DataFrame, y: str, unit: str, time: str, treated, start, rounds: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Donor weights (on the simplex, fitted before ``start``) and the path (time, observed, synthetic, gap); at most 5,000 units."""
    rows = df.groupBy(F.col(unit).alias("u"), F.col(time).alias("t")).agg(F.avg(F.col(y).cast("double")).alias("y"))
    pre = rows.where(F.col("t") < F.lit(start))
    got = pre.limit(5_000_001).collect()
    units, times = sorted({r["u"] for r in got}), sorted({r["t"] for r in got})
    if len(got) > 5_000_000 or len(units) > 5_000:
        raise ValueError("more than 5,000 units")
    table = {(r["u"], r["t"]): r["y"] for r in got}
    donors = [u for u in units if u != treated and all((u, t) in table for t in times)]
    x, target = np.array([[table[u, t] for u in donors] for t in times]), np.array([table[treated, t] for t in times])
    w, g = np.full(len(donors), 1 / len(donors)), x.T @ x
    for _ in range(rounds):  # Frank-Wolfe with pairwise steps and exact length
        grad = g @ w - x.T @ target
        to, away = int(grad.argmin()), int(np.where(w > 0, grad, -np.inf).argmax())
        gap = float(grad[away] - grad[to])
        bend = float(g[to, to] + g[away, away] - 2 * g[to, away])
        if gap < 1e-10 * (1 + abs(float(target @ target))) or bend <= 0:
            break
        size = min(w[away], gap / bend)
        w[to], w[away] = w[to] + size, w[away] - size
    weights = df.sparkSession.createDataFrame([(u, float(v)) for u, v in zip(donors, w, strict=True)], f"unit {dict(df.dtypes)[unit]}, weight double")
    made = rows.join(F.broadcast(weights.withColumnRenamed("unit", "u")), "u").groupBy("t").agg(F.sum(F.col("weight") * F.col("y")).alias("synthetic"))  # at most 5,000 rows
    own = rows.where(F.col("u") == F.lit(treated)).select("t", F.col("y").alias("observed"))
    return weights, own.join(made, "t").select(F.col("t").alias("time"), "observed", "synthetic", (F.col("observed") - F.col("synthetic")).alias("gap"))


def rd_bandwidth(df: DataFrame, y: str, running: str, cutoff: float) -> float:
    """Imbens and Kalyanaraman's plug-in bandwidth of a sharp design with triangular weights."""
    x, v = F.col(running).cast("double") - cutoff, F.col(y).cast("double")
    rows = df.select(x.alias("x"), v.alias("y")).dropna()
    n, sd = rows.agg(F.count("*"), F.stddev_samp("x")).first()
    h1 = 1.84 * sd * n ** (-1 / 5)
    side = {}
    for r in rows.where(F.abs("x") <= h1).groupBy((F.col("x") >= 0).alias("s")).agg(F.count("*").alias("n"), F.var_samp("y").alias("v")).collect():
        side[r["s"]] = (r["n"], r["v"])
    density = sum(c for c, _ in side.values()) / (2 * n * h1)
    spread = sum(c * s for c, s in side.values()) / sum(c for c, _ in side.values())
    cubic = rows.withColumns({"d": (F.col("x") >= 0).cast("double"), "x2": F.col("x") ** 2, "x3": F.col("x") ** 3})
    m3 = 6 * float(ols(cubic, "y", ["d", "x", "x2", "x3"]).coef[4])
    curve, penalty = {}, 0.0
    for s in (True, False):
        part = rows.where((F.col("x") >= 0) == F.lit(s))
        count = part.count()
        h2 = 3.56 * (spread / (density * max(m3 * m3, 1e-12))) ** (1 / 7) * count ** (-1 / 7)
        near = part.where(F.abs("x") <= h2).withColumn("x2", F.col("x") ** 2)
        curve[s] = 2 * float(ols(near, "y", ["x", "x2"]).coef[2])
        penalty += 2160 * spread / (max(near.count(), 1) * h2**4)
    return float(3.4375 * (2 * spread / (density * ((curve[True] - curve[False]) ** 2 + penalty))) ** (1 / 5) * n ** (-1 / 5))


def fuzzy_rd(df: DataFrame, y: str, treatment: str, running: str, cutoff: float, bandwidth: float) -> DataFrame:
    """(effect, outcome_jump, treatment_jump): the ratio of the jumps of outcome and treatment."""
    a = rd_local_linear(df, y, running, cutoff, bandwidth).select(F.col("effect").alias("outcome_jump"))
    b = rd_local_linear(df, treatment, running, cutoff, bandwidth).select(F.col("effect").alias("treatment_jump"))
    return a.crossJoin(b).select((F.col("outcome_jump") / F.col("treatment_jump")).alias("effect"), "outcome_jump", "treatment_jump")  # one row each


def rd_many(df: DataFrame, y: str, running: str, cutoffs: list[float], bandwidth: float) -> DataFrame:
    """(cutoff, effect, n_left, n_right) at several cutoffs."""
    out = None
    for c in cutoffs:
        one = rd_local_linear(df, y, running, c, bandwidth).select(F.lit(float(c)).alias("cutoff"), "effect", "n_left", "n_right")
        out = one if out is None else out.unionByName(one)
    return out


def rd_sensitivity(df: DataFrame, y: str, running: str, cutoff: float, bandwidths: list[float]) -> DataFrame:
    """(bandwidth, effect): the estimate over a range of bandwidths."""
    out = None
    for b in bandwidths:
        one = rd_local_linear(df, y, running, cutoff, b).select(F.lit(float(b)).alias("bandwidth"), "effect")
        out = one if out is None else out.unionByName(one)
    return out


def iv_bounds(df: DataFrame, y: str, treatment: str, instrument: str) -> DataFrame:
    """(low, high): Balke and Pearl's bounds of the average effect of three 0/1 columns, from eight probabilities."""
    cells = df.groupBy(F.col(instrument).cast("int").alias("z"), F.col(y).cast("int").alias("y"), F.col(treatment).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()  # at most eight rows
    n = {z: sum(r["n"] for r in cells if r["z"] == z) for z in (0, 1)}
    p = {(a, b, z): sum(r["n"] for r in cells if (r["y"], r["d"], r["z"]) == (a, b, z)) / n[z] for a in (0, 1) for b in (0, 1) for z in (0, 1)}
    q = lambda a, b, z: p[a, b, z]
    low = max(
        q(1, 1, 1) + q(0, 0, 0) - 1, q(1, 1, 0) + q(0, 0, 1) - 1, q(1, 1, 0) - q(1, 1, 1) - q(1, 0, 1) - q(0, 1, 0) - q(1, 0, 0), q(1, 1, 1) - q(1, 1, 0) - q(1, 0, 0) - q(0, 1, 1) - q(1, 0, 1),
        -q(0, 1, 1) - q(1, 0, 1), -q(0, 1, 0) - q(1, 0, 0), q(0, 0, 1) - q(0, 1, 1) - q(1, 0, 1) - q(0, 1, 0) - q(0, 0, 0), q(0, 0, 0) - q(0, 1, 0) - q(1, 0, 0) - q(0, 1, 1) - q(0, 0, 1),
    )
    high = min(
        1 - q(0, 1, 1) - q(1, 0, 0), 1 - q(0, 1, 0) - q(1, 0, 1), -q(0, 1, 0) + q(0, 1, 1) + q(0, 0, 1) + q(1, 1, 0) + q(0, 0, 0), -q(0, 1, 1) + q(1, 1, 1) + q(0, 0, 1) + q(0, 1, 0) + q(0, 0, 0),
        q(1, 1, 1) + q(0, 0, 1), q(1, 1, 0) + q(0, 0, 0), -q(1, 0, 1) + q(1, 1, 1) + q(0, 0, 1) + q(1, 1, 0) + q(1, 0, 0), -q(1, 0, 0) + q(1, 1, 0) + q(0, 0, 0) + q(1, 1, 1) + q(1, 0, 1),
    )
    return _row(df, "low double, high double", float(low), float(high))


def panel_unit_root(df: DataFrame, y: str, entity: str, time: list[str]) -> DataFrame:
    """(mean_t, entities): Im, Pesaran and Shin's mean of the entities' Dickey-Fuller t statistics (constant, no lags), sums per entity."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(*time)
    v = F.col(y).cast("double")
    rows = df.select(entity, F.lag(v).over(w).alias("x"), (v - F.lag(v).over(w)).alias("y")).dropna()
    g = rows.groupBy(entity).agg(F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.count("*").alias("n")).where("n > 3 and sxx > 0")
    t = F.col("b") / F.sqrt((F.col("syy") - F.col("b") ** 2 * F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return g.agg(F.avg(t).alias("mean_t"), F.count("*").alias("entities"))
