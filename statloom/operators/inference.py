"""More tests and descriptions: from one aggregate, from ranks, or from a small table of cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.special import p_value
from . import stats
from .moments import no_nulls, products
from .ranks import value_ranks
from .survival import labels

#: Rows of one ordered sample that are brought to the driver at most; more are weighed where they are.
MAX_SAMPLE = 5000


def _frame(spark, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(None if v is None else v for v in r) for r in rows], names)


def _value(df: DataFrame, column: str) -> DataFrame:
    return df.select(stats._x(column).alias("x")).where("x is not null")


def fivenum(df: DataFrame, column: str) -> DataFrame:
    """Tukey's five numbers: minimum, hinges, median and maximum, from counts per value."""
    ranks = value_ranks(_value(df, column), "x")
    n = ranks.agg(F.sum("n")).first()[0] or 0
    depth = (n + 3) // 2 / 2
    spots = [1.0, depth, (n + 1) / 2, n + 1 - depth, float(n)]
    at = lambda k: F.min(F.when(F.col("below") + F.col("n") >= k, F.col("x")))
    row = ranks.agg(*(at(f(s)).alias(f"{k}{i}") for i, s in enumerate(spots) for k, f in (("a", math.floor), ("b", math.ceil)))).first()
    values = [(row[f"a{i}"] + row[f"b{i}"]) / 2 if n else None for i in range(5)]
    return _frame(df.sparkSession, "minimum double, lower_hinge double, median double, upper_hinge double, maximum double", [tuple(values)])


def quantiles(df: DataFrame, column: str, probabilities: list[float], kind: int = 7) -> DataFrame:
    """Sample quantiles of types 1 to 9, from counts per value (no sort of the rows)."""
    ranks = value_ranks(_value(df, column), "x")
    n = ranks.agg(F.sum("n")).first()[0] or 0
    #: The (a, b) of the plotting positions of the continuous types.
    ab = {4: (0.0, 1.0), 5: (0.5, 0.5), 6: (0.0, 0.0), 7: (1.0, 1.0), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}
    spots = []
    for p in probabilities:
        if kind in ab:
            a, b = ab[kind]
            h = a + p * (n + 1 - a - b)
            j, g = math.floor(h + 1e-12), h - math.floor(h + 1e-12)
        else:
            h = n * p - (0.5 if kind == 3 else 0.0)
            j = math.floor(h + 1e-12)
            whole = abs(h - j) < 1e-12
            g = (0.0 if whole else 1.0) if kind == 1 else (0.5 if whole else 1.0) if kind == 2 else (0.0 if whole and j % 2 == 0 else 1.0)
        spots.append((min(max(j, 1), n), min(max(j + 1, 1), n), g))
    at = lambda k: F.min(F.when(F.col("below") + F.col("n") >= k, F.col("x")))
    row = ranks.agg(*(at(s[k]).alias(f"v{i}_{k}") for i, s in enumerate(spots) for k in (0, 1))).first()
    out = [(float(p), float((1 - s[2]) * row[f"v{i}_0"] + s[2] * row[f"v{i}_1"]) if n else None) for i, (p, s) in enumerate(zip(probabilities, spots, strict=True))]
    return _frame(df.sparkSession, "probability double, value double", out)


def weighted_mean(df: DataFrame, column: str, weight: str) -> DataFrame:
    x, w = F.col(column).cast("double"), F.col(weight).cast("double")
    used = df.where(x.isNotNull() & w.isNotNull())
    return used.agg((F.sum(x * w) / F.sum(w)).alias("mean"), F.sum(w).alias("total_weight"), F.count("*").alias("n"))


def weighted_covariance(df: DataFrame, columns: list[str], weight: str, unbiased: bool = True, correlation: bool = False) -> DataFrame:
    """(a, b, value): covariances or correlations with weights that sum to one."""
    no_nulls(df, [*columns, weight])
    w = F.col(weight).cast("double")
    total, squares, *means = df.agg(F.sum(w), F.sum(w * w), *(F.sum(w * F.col(c)) / F.sum(w) for c in columns)).first()
    s = products(df, [F.col(c).cast("double") - m for c, m in zip(columns, means, strict=True)], w) / total
    s = s / (1 - squares / total**2) if unbiased else s
    if correlation:
        s = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
    return _frame(df.sparkSession, "a string, b string, value double", [(a, b, float(s[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)])


def mahalanobis(df: DataFrame, columns: list[str], name: str = "distance") -> DataFrame:
    """``df`` with the squared distance of each row from the mean, as a column expression of the inverse covariance."""
    no_nulls(df, columns)
    row = df.agg(F.count("*"), *(F.avg(F.col(c).cast("double")) for c in columns)).first()
    z = [F.col(c).cast("double") - m for c, m in zip(columns, row[1:], strict=True)]
    inv = np.linalg.inv(products(df, z) / (row[0] - 1))
    return df.withColumn(name, sum((float(inv[i, j]) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0)))


def density(df: DataFrame, column: str, points: int = 512, bandwidth: float | None = None) -> DataFrame:
    """(x, density): Gaussian kernel estimate; rows are counted into the grid's cells with linear weights, the grid is smoothed on the driver."""
    rows = _value(df, column)
    n, sd, low, high, q = rows.agg(F.count("*"), F.stddev_samp("x"), F.min("x"), F.max("x"), F.percentile_approx("x", [0.25, 0.75], 10_000)).first()
    spread = min(s for s in (sd, (q[1] - q[0]) / 1.34, 1.0) if s) if sd else 1.0
    spread = min(sd, (q[1] - q[0]) / 1.34) or sd or spread
    h = bandwidth or 0.9 * spread * n**-0.2
    low, high = low - 3 * h, high + 3 * h
    step = (high - low) / (points - 1)
    at = (F.col("x") - low) / step
    cells = rows.select(F.floor(at).cast("int").alias("k"), (at - F.floor(at)).alias("r")).groupBy("k").agg(F.sum(1 - F.col("r")).alias("a"), F.sum("r").alias("b")).collect()  # a row per cell
    mass = np.zeros(points + 1)
    for c in cells:
        mass[c["k"]] += c["a"]
        mass[c["k"] + 1] += c["b"]
    grid = np.arange(points) * step
    kernel = np.exp(-0.5 * ((grid[:, None] - grid[None, :]) / h) ** 2) / (h * math.sqrt(2 * math.pi))
    y = kernel @ mass[:points] / n
    return _frame(df.sparkSession, "x double, density double", [(float(low + g), float(v)) for g, v in zip(grid, y, strict=True)])


def binomial_test(successes: int, trials: int, p: float = 0.5, alternative: str = "two-sided", level: float = 0.95) -> dict[str, float]:
    """Exact test and Clopper-Pearson limits."""
    log = lambda k: math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + (k * math.log(p) if k else 0.0) + ((trials - k) * math.log1p(-p) if k < trials else 0.0)
    at_least = special.beta_i(successes, trials - successes + 1, p) if successes else 1.0
    at_most = 1 - special.beta_i(successes + 1, trials - successes, p) if successes < trials else 1.0
    if alternative == "greater":
        value = at_least
    elif alternative == "less":
        value = at_most
    else:
        here = log(successes) + 1e-7
        value = at_most if successes < trials * p else at_least
        other = range(math.ceil(trials * p), trials + 1) if successes < trials * p else range(0, math.floor(trials * p) + 1)
        value = min(1.0, value + math.fsum(math.exp(log(k)) for k in other if k != successes and log(k) <= here))
    tail = (1 - level) / 2 if alternative == "two-sided" else 1 - level
    quantile = lambda a, b, q: special.inverse(lambda x: special.beta_i(a, b, x), q, 0.0, 1.0)
    low = quantile(successes, trials - successes + 1, tail) if successes and alternative != "less" else 0.0
    high = quantile(successes + 1, trials - successes, 1 - tail) if successes < trials and alternative != "greater" else 1.0
    return {"estimate": successes / trials, "p_value": value, "low": low, "high": high}


def poisson_test(events: int, exposure: float = 1.0, rate: float = 1.0, alternative: str = "two-sided", level: float = 0.95) -> dict[str, float]:
    """Exact test of a rate with its limits."""
    m = rate * exposure
    log = lambda k: k * math.log(m) - m - math.lgamma(k + 1)
    at_least = 1 - special.gamma_q(events, m) if events else 1.0
    at_most = special.gamma_q(events + 1, m)
    if alternative == "greater":
        value = at_least
    elif alternative == "less":
        value = at_most
    else:
        here, value = log(events) + 1e-7, at_most if events < m else at_least
        if events < m:
            k = math.ceil(m)
            while log(k) > here:
                k += 1
            value += 1 - special.gamma_q(k, m) if k else 1.0
        elif events > m:
            k = math.floor(m)
            while k >= 0 and log(k) > here:
                k -= 1
            value += special.gamma_q(k + 1, m) if k >= 0 else 0.0
        else:
            value = 1.0
    tail = (1 - level) / 2 if alternative == "two-sided" else 1 - level
    upper = max(50.0, 20.0 * (events + 5))
    quantile = lambda a, q: special.inverse(lambda x: 1 - special.gamma_q(a, x), q, 0.0, upper)
    low = quantile(events, tail) / exposure if events and alternative != "less" else 0.0
    high = quantile(events + 1, 1 - tail) / exposure if alternative != "greater" else math.inf
    return {"estimate": events / exposure, "p_value": min(1.0, value), "low": low, "high": high}


def proportion_test(df: DataFrame, success: Column, group: str, continuity: bool = False) -> DataFrame:
    """Equality of the shares of k groups, and for k groups in order the trend with their numbers 1..k."""
    rows = df.select(F.col(group).alias("g"), success.cast("int").alias("x")).where("g is not null and x is not null")
    cells = rows.groupBy("g").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    got = sorted((r["g"], r["s"], r["n"]) for r in cells.collect())  # a row per group
    s, n = (np.array([float(g[i]) for g in got]) for i in (1, 2))
    p = s.sum() / n.sum()
    gap = np.abs(s - n * p)
    gap = np.maximum(gap - 0.5, 0) if continuity and len(s) == 2 else gap
    stat = float((gap**2 / (n * p * (1 - p))).sum())
    score = np.arange(1, len(s) + 1)
    mid = (n * score).sum() / n.sum()
    trend = float((score * (s - n * p)).sum() ** 2 / (p * (1 - p) * (n * (score - mid) ** 2).sum()))
    return _frame(df.sparkSession, "statistic double, df double, p_value double, trend_statistic double, trend_p_value double", [(stat, float(len(s) - 1), special.chi2_upper(stat, len(s) - 1), trend, special.chi2_upper(trend, 1))])


def studentized_range_upper(q: float, groups: int, df: float) -> float:
    """P(range of ``groups`` normal values over an independent deviation > q), by Gauss-Legendre sums over both."""
    if q <= 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(96)
    z, zw = x * 8, w * 8
    cdf = np.vectorize(special.normal_cdf)
    phi, below = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), cdf(z)
    inner = lambda r: float(groups * (zw * phi * np.clip(below - cdf(z - r), 0, 1) ** (groups - 1)).sum())
    if df > 20_000:
        return max(0.0, 1 - inner(q))
    width = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - width), 1 + width if df > 4 else 6.0 + 8 / df
    s, sw = (high - low) / 2 * x + (high + low) / 2, (high - low) / 2 * w
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float((sw * np.exp(log) * np.array([inner(q * v) for v in s])).sum())))


def tukey_hsd(df: DataFrame, value: str, group: str, level: float = 0.95) -> DataFrame:
    """All pairs of group means with honest limits and p-values (unequal sizes by Kramer's rule)."""
    g = sorted((r["g"], r["n"], r["m"], r["v"] or 0.0) for r in stats._groups(df, value, group).collect())  # a row per group
    k, n = len(g), sum(r[1] for r in g)
    dof = n - k
    mse = sum((r[1] - 1) * r[3] for r in g) / dof
    critical = special.inverse(lambda q: 1 - studentized_range_upper(q, k, dof), level, 0.0, 60.0)
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            d, se = g[j][2] - g[i][2], math.sqrt(mse / 2 * (1 / g[i][1] + 1 / g[j][1]))
            out.append((str(g[j][0]), str(g[i][0]), float(d), d - critical * se, d + critical * se, studentized_range_upper(abs(d) / se, k, dof)))
    return _frame(df.sparkSession, "a string, b string, difference double, low double, high double, p_value double", out)


def pairwise_t(df: DataFrame, value: str, group: str, adjust: str = "holm", pooled: bool = True) -> DataFrame:
    """t tests of all pairs of groups with adjusted p-values."""
    g = sorted((r["g"], r["n"], r["m"], r["v"] or 0.0) for r in stats._groups(df, value, group).collect())  # a row per group
    dof = sum(r[1] - 1 for r in g)
    mse = sum((r[1] - 1) * r[3] for r in g) / dof
    out = []
    for i in range(len(g)):
        for j in range(i):
            (_, n1, m1, v1), (_, n2, m2, v2) = g[i], g[j]
            if pooled:
                t, d = (m1 - m2) / math.sqrt(mse * (1 / n1 + 1 / n2)), dof
            else:
                a, b = v1 / n1, v2 / n2
                t, d = (m1 - m2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
            out.append((str(g[i][0]), str(g[j][0]), float(t), float(d), special.t_two_sided(t, d)))
    adjusted = special.adjust_p([o[4] for o in out], adjust) if adjust != "none" else [o[4] for o in out]
    return _frame(df.sparkSession, "a string, b string, statistic double, df double, p_value double, adjusted double", [(*o, p) for o, p in zip(out, adjusted, strict=True)])


def pairwise_wilcoxon(df: DataFrame, value: str, group: str, adjust: str = "holm") -> DataFrame:
    """Rank-sum tests of all pairs of groups with adjusted p-values."""
    names = labels(df, group)
    out = []
    for i in range(len(names)):
        for j in range(i):
            r = stats.mann_whitney(df, value, group, names[i], names[j]).first()
            out.append((str(names[i]), str(names[j]), float(r["statistic"]), float(r["p_value"])))
    adjusted = special.adjust_p([o[3] for o in out], adjust) if adjust != "none" else [o[3] for o in out]
    return _frame(df.sparkSession, "a string, b string, statistic double, p_value double, adjusted double", [(*o, p) for o, p in zip(out, adjusted, strict=True)])


def _scored(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Counts per (group, value) and the ranks of the values."""
    rows = df.select(F.col(group).alias("g"), stats._x(value).alias("x")).where("g is not null and x is not null")
    cells = rows.groupBy("g", "x").agg(F.count("*").alias("c"))
    return cells, value_ranks(cells, "x", "c")


def _normal_quantile(p: Column) -> Column:
    """Normal quantile as a column: Acklam's rational approximation with a Halley step would need erfc; the relative error is 1.2e-9."""
    #: Coefficients of the rational approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(k, x):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    tail = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.ln(F.greatest(tail, F.lit(1e-300))))
    far = poly(c, q) / poly(d, q)
    r = (p - 0.5) * (p - 0.5)
    near = poly(a, r) * (p - 0.5) / poly(b, r)
    return F.when(tail > 0.02425, near).when(p < 0.5, far).otherwise(-far)


def fligner(df: DataFrame, value: str, group: str) -> DataFrame:
    """Fligner-Killeen test of equal variances: normal scores of the ranks of distances from group medians."""
    rows = df.select(F.col(group).alias("g"), stats._x(value).alias("x")).where("g is not null and x is not null")
    mid = rows.groupBy("g").agg(F.percentile("x", 0.5).alias("c"))
    far = rows.join(F.broadcast(mid), "g").select("g", F.abs(F.col("x") - F.col("c")).alias("x"))  # a row per group
    cells, ranks = _scored(far, "x", "g")
    n = far.count()
    score = _normal_quantile((1 + (F.col("below") + (F.col("n") + 1) / 2) / (n + 1)) / 2)
    scored = cells.join(ranks.select("x", score.alias("a")), "x")
    by = scored.groupBy("g").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("a")).alias("s"), F.sum(F.col("c") * F.col("a") ** 2).alias("q"))
    t = by.agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("groups"), F.sum(F.col("s") ** 2 / F.col("k")).alias("b"))
    mean = F.col("s") / F.col("n")
    v = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    out = t.select(((F.col("b") - F.col("n") * mean * mean) / v).alias("statistic"), (F.col("groups") - 1).cast("double").alias("df"))
    return out.withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def mood(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Mood's test of scale for two groups, with average scores of ties."""
    cells, ranks = _scored(df.where(F.col(group).isin(a, b)), value, group)
    n = cells.agg(F.sum("c")).first()[0]
    low, k = F.col("below").cast("double"), F.col("n").cast("double")
    upto = lambda m: m * (m + 1) * (2 * m + 1) / 6 - (n + 1) / 2 * m * (m + 1) + m * ((n + 1) / 2) ** 2  # sum of (i - mean)^2 up to m
    score = (upto(low + k) - upto(low)) / k
    scored = cells.join(ranks.select("x", score.alias("a")), "x")
    s = scored.agg(F.sum(F.when(F.col("g") == F.lit(a), F.col("c") * F.col("a"))).alias("statistic"), F.sum(F.when(F.col("g") == F.lit(a), F.col("c"))).alias("m"), F.sum(F.col("c") * F.col("a")).alias("s"), F.sum(F.col("c") * F.col("a") ** 2).alias("q"))
    m, mean = F.col("m").cast("double"), F.col("s") / n
    var = m * (n - m) / (n * (n - 1.0)) * (F.col("q") - n * mean * mean)
    return s.select("statistic", ((F.col("statistic") - m * mean) / F.sqrt(var)).alias("z")).withColumn("p_value", p_value("z", F.col("z")))


def ansari(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Ansari-Bradley test of scale for two groups, normal approximation with average scores of ties."""
    cells, ranks = _scored(df.where(F.col(group).isin(a, b)), value, group)
    n = cells.agg(F.sum("c")).first()[0]
    low, k = F.col("below").cast("double"), F.col("n").cast("double")
    h = n // 2
    whole = (h + 1) ** 2 if n % 2 else h * (h + 1)
    # sum of min(i, n + 1 - i) up to m
    upto = lambda m: F.when(m <= (n + 1) // 2, m * (m + 1) / 2).otherwise(whole - (n - m) * (n - m + 1) / 2)
    score = (upto(low + k) - upto(low)) / k
    scored = cells.join(ranks.select("x", score.alias("a")), "x")
    s = scored.agg(F.sum(F.when(F.col("g") == F.lit(a), F.col("c") * F.col("a"))).alias("statistic"), F.sum(F.when(F.col("g") == F.lit(a), F.col("c"))).alias("m"), F.sum(F.col("c") * F.col("a")).alias("s"), F.sum(F.col("c") * F.col("a") ** 2).alias("q"))
    m, mean = F.col("m").cast("double"), F.col("s") / n
    var = m * (n - m) / (n * (n - 1.0)) * (F.col("q") - n * mean * mean)
    return s.select("statistic", ((F.col("statistic") - m * mean) / F.sqrt(var)).alias("z")).withColumn("p_value", p_value("z", F.col("z")))


def quade(df: DataFrame, value: str, treatment: str, block: str) -> DataFrame:
    """Quade's test of a complete block design: ranks within blocks, weighted by the ranks of the blocks' ranges."""
    from pyspark.sql import Window

    rows = df.select(F.col(block).alias("b"), F.col(treatment).alias("t"), stats._x(value).alias("x")).where("x is not null")
    spread = rows.groupBy("b").agg((F.max("x") - F.min("x")).alias("x"))
    from .ranks import average_ranks

    weight = average_ranks(spread, "x", "q").select("b", "q")
    same, within = Window.partitionBy("b", "x"), Window.partitionBy("b").orderBy("x")
    ranked = rows.withColumn("r", F.rank().over(within) + (F.count("*").over(same) - 1) / 2).join(weight, "b")
    k = len(labels(rows, "t"))
    s = F.col("q") * (F.col("r") - (k + 1) / 2)
    by = ranked.groupBy("t").agg(F.sum(s).alias("s"), F.sum(s * s).alias("a"), F.count("*").alias("n"))
    t = by.agg(F.sum("a").alias("a"), (F.sum(F.col("s") ** 2) / F.max("n")).alias("b"), F.max("n").alias("n"))
    out = t.select(((F.col("n") - 1) * F.col("b") / (F.col("a") - F.col("b"))).alias("statistic"), F.lit(float(k - 1)).alias("df1"), ((k - 1.0) * (F.col("n") - 1)).alias("df2"))
    return out.withColumn("p_value", p_value("f", F.col("statistic"), F.col("df1"), F.col("df2")))


def mantel_haenszel(df: DataFrame, a: str, b: str, stratum: str, continuity: bool = True) -> DataFrame:
    """Common odds ratio of 2 x 2 tables of two 0/1 columns over strata, with the chi-squared test and Robins-Breslow-Greenland limits."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(stratum).isNotNull()).groupBy(stratum).agg(*(F.count_if((F.col(a) == i) & (F.col(b) == j)).cast("double").alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)))
    p, q, r, s = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = p + q + r + s
    rr, ss = p * s / n, q * r / n
    pp, qq = (p + s) / n, (q + r) / n
    t = cells.where(n > 1).agg(
        F.sum(p - (p + q) * (p + r) / n).alias("d"), F.sum((p + q) * (p + r) * (q + s) * (r + s) / (n * n * (n - 1))).alias("v"), F.sum(rr).alias("rr"), F.sum(ss).alias("ss"),
        F.sum(pp * rr).alias("pr"), F.sum(pp * ss + qq * rr).alias("mix"), F.sum(qq * ss).alias("qs"), F.count("*").alias("strata"),
    ).first()
    gap = max(0.0, abs(t["d"]) - (0.5 if continuity else 0.0))
    stat, ratio = gap**2 / t["v"], t["rr"] / t["ss"]
    se = math.sqrt(t["pr"] / (2 * t["rr"] ** 2) + t["mix"] / (2 * t["rr"] * t["ss"]) + t["qs"] / (2 * t["ss"] ** 2))
    z = special.normal_quantile(0.975)
    return _frame(df.sparkSession, "statistic double, df double, p_value double, odds_ratio double, low double, high double, strata long", [(stat, 1.0, special.chi2_upper(stat, 1), ratio, ratio * math.exp(-z * se), ratio * math.exp(z * se), t["strata"])])


def _within(df: DataFrame, columns: list[str], group: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Matrices of products within and between groups, from sums and products per group."""
    no_nulls(df, [*columns, group])
    k = len(columns)
    centre = df.agg(*(F.avg(F.col(c).cast("double")) for c in columns)).first()
    z = [F.col(c).cast("double") - m for c, m in zip(columns, centre, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = df.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs))
    row = g.agg(F.count("*").alias("g"), F.sum("n").alias("n"), *(F.sum(F.col(f"p{i}_{j}")).alias(f"p{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"b{i}_{j}") for i, j in pairs)).first()
    full = lambda name: np.array([[row[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    between = full("b")
    return full("p") - between, between, row["g"], row["n"]


def manova(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """One-way multivariate analysis of variance: Pillai, Wilks, Hotelling-Lawley and Roy with approximate F tests."""
    e, h, g, n = _within(df, columns, group)
    p, q, v = len(columns), g - 1, n - g
    roots = np.clip(np.linalg.eigvals(np.linalg.solve(e, h)).real, 0, None)
    s, m, w = min(p, q), (abs(p - q) - 1) / 2, (v - p - 1) / 2
    out = []
    pillai = float((roots / (1 + roots)).sum())
    d1, d2 = s * (2 * m + s + 1), s * (2 * w + s + 1)
    out.append(("pillai", pillai, d2 / d1 * pillai / (s - pillai), d1, d2))
    wilks = float(np.prod(1 / (1 + roots)))
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d1, d2 = p * q, (v + q - (p + q + 1) / 2) * t - (p * q - 2) / 2
    lam = wilks ** (1 / t)
    out.append(("wilks", wilks, (1 - lam) / lam * d2 / d1, d1, d2))
    trace = float(roots.sum())
    d1, d2 = s * (2 * m + s + 1), 2 * (s * w + 1)
    out.append(("hotelling-lawley", trace, d2 * trace / (s * d1), d1, d2))
    roy, r = float(roots.max()), max(p, q)
    out.append(("roy", roy, roy * (v - r + q) / r, r, v - r + q))
    return _frame(df.sparkSession, "test string, value double, statistic double, df1 double, df2 double, p_value double", [(a, b, float(f), float(x), float(y), special.f_upper(f, x, y)) for a, b, f, x, y in out])


def mauchly(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mauchly's test of sphericity of repeated measures, with the Greenhouse-Geisser and Huynh-Feldt factors."""
    no_nulls(df, columns)
    p = len(columns)
    row = df.agg(F.count("*"), *(F.avg(F.col(c).cast("double")) for c in columns)).first()
    n = row[0]
    cov = products(df, [F.col(c).cast("double") - m for c, m in zip(columns, row[1:], strict=True)]) / (n - 1)
    base = np.linalg.qr(np.column_stack([np.ones(p), np.eye(p)[:, 1:]]))[0][:, 1:]  # orthonormal contrasts
    t = base.T @ cov @ base
    k = p - 1
    w = float(np.linalg.det(t) / (np.trace(t) / k) ** k)
    f = 1 - (2 * k * k + k + 2) / (6 * k * (n - 1))
    df_ = k * (k + 1) / 2 - 1
    stat = -(n - 1) * f * math.log(w)
    gg = float(np.trace(t) ** 2 / (k * np.trace(t @ t)))
    hf = min(1.0, (n * k * gg - 2) / (k * (n - 1 - k * gg)))
    return _frame(df.sparkSession, "w double, statistic double, df double, p_value double, greenhouse_geisser double, huynh_feldt double", [(w, stat, df_, special.chi2_upper(stat, df_), gg, hf)])


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """Shapiro-Wilk test by Royston's approximation, of 3 rows or more.

    Up to ``MAX_SAMPLE`` rows are sorted on the driver; more are weighed by the
    normal scores of their ranks in one aggregate, and their p-value is null:
    Royston's formula, carried on to 90,000 normal rows, gave p < 0.05 in 0.4 % of
    1,000 samples.
    """
    rows = _value(df, column)
    x = np.sort(np.array([r[0] for r in rows.limit(MAX_SAMPLE + 1).collect()]))
    if len(x) > MAX_SAMPLE:
        w, n = _shapiro_many(rows)
        return _frame(df.sparkSession, "statistic double, p_value double, n long", [(w, None, n)])
    n = len(x)
    if n < 3:
        raise ValueError("3 rows or more are needed")
    m = np.array([special.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n > 3:
        an, an1, phi = _outer_weights(n, float(m @ m), m[-1], m[-2])
        a = m / math.sqrt(phi)
        if n > 5:
            a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
        else:
            a[-1], a[0] = an, -an
    else:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    return _frame(df.sparkSession, "statistic double, p_value double, n long", [(w, _royston(w, n), n)])


def _outer_weights(n: int, norm: float, m1: float, m2: float) -> tuple[float, float, float]:
    """Weights of the largest and the next value, and the square that divides the scores of the others."""
    u = 1 / math.sqrt(n)
    #: Royston's polynomials for the outer weights.
    an = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m1 / math.sqrt(norm)], u))
    if n <= 5:
        return an, math.nan, (norm - 2 * m1**2) / (1 - 2 * an**2)
    an1 = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m2 / math.sqrt(norm)], u))
    return an, an1, (norm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * an**2 - 2 * an1**2)


def _royston(w: float, n: int) -> float:
    #: Royston's polynomials for the mean and the deviation.
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    elif n <= 11:
        gamma = -2.273 + 0.459 * n
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        p = 0.0 if math.log1p(-w) >= gamma else 1 - special.normal_cdf((-math.log(gamma - math.log1p(-w)) - mu) / sd)
    else:
        v = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
        p = 1 - special.normal_cdf((math.log1p(-w) - mu) / sd)
    return float(p)


def _shapiro_many(rows: DataFrame) -> tuple[float, int]:
    """W and the number of rows of many: one aggregate of products with normal scores over the ranks, a row per rank."""
    mean = rows.agg(F.avg("x")).first()[0]
    ranks = value_ranks(rows, "x").persist()
    n = ranks.agg(F.sum("n")).first()[0]
    # the rows of a value have its ranks; a frequent value's ranks are told in blocks
    blocks = ranks.select((F.col("x") - mean).alias("x"), (F.col("below") + F.col("n")).alias("last"), F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("n"), F.lit(4096))).alias("first"))
    each = blocks.select("x", F.explode(F.sequence("first", F.least(F.col("first") + 4095, "last"))).alias("i"))
    m = special.normal_quantile_of((F.col("i") - (n + 1) / 2) / (n + 0.25), (F.least(F.col("i"), n + 1 - F.col("i")) - 0.375) / (n + 0.25))
    s = each.agg(F.sum(m * m).alias("norm"), F.sum(m * F.col("x")).alias("product"), F.sum(F.col("x") * F.col("x")).alias("squares"), F.sum("x").alias("rest")).first()
    at = [F.min(F.when(F.col("below") + F.col("n") >= i, F.col("x"))).alias(f"x{i}") for i in (1, 2, n - 1, n)]
    outer = np.array(ranks.agg(*at).first()) - mean
    ranks.unpersist()
    m1, m2 = (special.normal_quantile((i - 0.375) / (n + 0.25)) for i in (n, n - 1))
    an, an1, phi = _outer_weights(n, s["norm"], m1, m2)
    product = (s["product"] - float(outer @ [-m1, -m2, m2, m1])) / math.sqrt(phi) + float(outer @ [-an, -an1, an1, an])
    return float(product**2 / (s["squares"] - s["rest"] ** 2 / n)), n


def ks_one(df: DataFrame, column: str, distribution: str = "normal", a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Kolmogorov-Smirnov test against normal(a, b), uniform(a, b) or exponential(rate a), from counts per value."""
    from .moments import _normal_cdf

    x = F.col("x")
    cdf = {"normal": lambda: _normal_cdf((x - a) / b), "uniform": lambda: F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0)), "exponential": lambda: F.when(x <= 0, 0.0).otherwise(1 - F.exp(-a * x))}[distribution]()
    ranks = value_ranks(_value(df, column), "x")
    n = ranks.agg(F.sum("n")).first()[0]
    gap = F.greatest((F.col("below") + F.col("n")) / n - cdf, cdf - F.col("below") / n)
    s = ranks.agg(F.max(gap).alias("statistic")).withColumn("n", F.lit(n))
    return s.withColumn("p_value", p_value("ks", F.sqrt("n") * F.col("statistic")))


def cell_means(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """Means, effects (differences from the grand mean) and numbers of the levels of each factor and of their cells."""
    rows = df.select(*factors, stats._x(value).alias("x")).where("x is not null")
    sets = [*([f] for f in factors), *([factors] if len(factors) > 1 else [])]
    grand = rows.agg(F.avg("x").alias("__grand"))
    out = None
    for keys in sets:
        one = rows.groupBy(*keys).agg(F.avg("x").alias("mean"), F.count("*").alias("n")).crossJoin(grand)  # one row
        one = one.select(F.lit(":".join(keys)).alias("term"), F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias("level"), "mean", (F.col("mean") - F.col("__grand")).alias("effect"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def contrast(df: DataFrame, value: str, group: str, weights: dict) -> DataFrame:
    """A contrast of group means: estimate, standard error from the pooled variance, t test."""
    if abs(sum(weights.values())) > 1e-9:
        raise ValueError("the weights of a contrast sum to zero")
    g = {r["g"]: r for r in stats._groups(df, value, group).collect()}  # a row per group
    dof = sum(r["n"] - 1 for r in g.values())
    mse = sum((r["n"] - 1) * (r["v"] or 0.0) for r in g.values()) / dof
    estimate = sum(w * g[k]["m"] for k, w in weights.items())
    se = math.sqrt(mse * sum(w * w / g[k]["n"] for k, w in weights.items()))
    return _frame(df.sparkSession, "estimate double, std_error double, statistic double, df double, p_value double", [(float(estimate), se, estimate / se, float(dof), special.t_two_sided(estimate / se, dof))])


def contrast_matrix(levels: int, kind: str = "treatment") -> np.ndarray:
    """Contrasts of a factor: treatment, sum, helmert or polynomial."""
    n = levels
    if kind == "treatment":
        return np.eye(n)[:, 1:]
    if kind == "sum":
        return np.vstack([np.eye(n - 1), -np.ones(n - 1)])
    if kind == "helmert":
        return np.array([[-1.0 if i <= j else float(j + 1) if i == j + 1 else 0.0 for j in range(n - 1)] for i in range(n)])
    if kind == "polynomial":
        x = np.arange(1, n + 1) - (n + 1) / 2
        q, r = np.linalg.qr(np.vander(x, n, increasing=True))
        return (q * np.sign(np.diag(r)))[:, 1:]
    raise ValueError(f"unknown contrasts {kind!r}")


def median_polish(df: DataFrame, value: str, row: str, column: str, rounds: int = 10, tolerance: float = 0.01) -> DataFrame:
    """Tukey's median polish of a two-way table (means of cells; at most a million cells): overall, row and column effects."""
    cells = df.groupBy(row, column).agg(F.avg(F.col(value).cast("double")).alias("x")).where("x is not null").limit(1_000_001).collect()
    if len(cells) > 1_000_000:
        raise ValueError("more than a million cells")
    rows, cols = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    z = np.full((len(rows), len(cols)), np.nan)
    for c in cells:
        z[rows.index(c[0]) if len(rows) < 50 else np.searchsorted(rows, c[0]), cols.index(c[1]) if len(cols) < 50 else np.searchsorted(cols, c[1])] = c[2]
    whole, re, ce, last = 0.0, np.zeros(len(rows)), np.zeros(len(cols)), None
    for _ in range(rounds):
        d = np.nanmedian(z, axis=1)
        z, re = z - d[:, None], re + d
        d = float(np.median(ce))
        ce, whole = ce - d, whole + d
        d = np.nanmedian(z, axis=0)
        z, ce = z - d, ce + d
        d = float(np.median(re))
        re, whole = re - d, whole + d
        size = float(np.nansum(np.abs(z)))
        if size == 0 or last is not None and abs(size - last) < tolerance * size:
            break
        last = size
    out = [("overall", "", whole), *(("row", str(k), float(v)) for k, v in zip(rows, re, strict=True)), *(("column", str(k), float(v)) for k, v in zip(cols, ce, strict=True))]
    return _frame(df.sparkSession, "term string, level string, effect double", out)


def loglinear(df: DataFrame, factors: list[str], margins: list[list[str]], rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """Log-linear model of a contingency table by iterative proportional fitting on its cells: likelihood ratio, Pearson statistic, df, p-values."""
    cells = df.dropna(subset=factors).groupBy(*factors).agg(F.count("*").alias("n")).limit(1_000_001).collect()
    if len(cells) > 1_000_000:
        raise ValueError("more than a million cells")
    sets = [sorted({c[f] for c in cells}) for f in factors]
    at = [{v: i for i, v in enumerate(s)} for s in sets]
    seen = np.zeros([len(s) for s in sets])
    for c in cells:
        seen[tuple(a[c[f]] for a, f in zip(at, factors, strict=True))] = c["n"]
    fit = np.ones_like(seen)
    drop = [tuple(i for i, f in enumerate(factors) if f not in m) for m in margins]
    for _ in range(rounds):
        old = fit.copy()
        for d in drop:
            have = fit.sum(axis=d, keepdims=True)
            fit = fit * np.divide(seen.sum(axis=d, keepdims=True), have, out=np.zeros_like(have), where=have > 0)
        if np.abs(fit - old).max() < tolerance * max(1.0, seen.max()):
            break
    else:
        raise RuntimeError(f"not converged after {rounds} rounds")
    # parameters: the distinct non-empty subsets of the margins
    from itertools import combinations

    terms = {s for m in margins for k in range(1, len(m) + 1) for s in combinations(sorted(m, key=factors.index), k)}
    used = 1 + sum(math.prod(len(sets[factors.index(f)]) - 1 for f in t) for t in terms)
    dof = seen.size - used
    ratio = 2 * float((seen[seen > 0] * np.log(seen[seen > 0] / fit[seen > 0])).sum())
    pearson = float(((seen - fit) ** 2)[fit > 0].sum() and ((seen - fit) ** 2 / np.where(fit > 0, fit, 1))[fit > 0].sum())
    p = lambda v: special.chi2_upper(max(v, 0.0), dof) if dof else 1.0
    return _frame(df.sparkSession, "likelihood_ratio double, pearson double, df int, p_likelihood_ratio double, p_pearson double", [(ratio, pearson, dof, p(ratio), p(pearson))])


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, fitted): the best increasing fit by Spark's isotonic regression over rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("label")).dropna()
    means = rows.groupBy("x").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(means)
    return IsotonicRegression(weightCol="weight").fit(data).transform(data).select("x", F.col("prediction").alias("fitted"))


def power_proportions(n: float, p1: float, p2: float, level: float = 0.05) -> float:
    """Power of the two-sided test of two shares with n rows each."""
    z, mid = special.normal_quantile(1 - level / 2), (p1 + p2) / 2
    return special.normal_cdf((math.sqrt(n) * abs(p1 - p2) - z * math.sqrt(2 * mid * (1 - mid))) / math.sqrt(p1 * (1 - p1) + p2 * (1 - p2)))


def power_anova(groups: int, n: float, between: float, within: float, level: float = 0.05) -> float:
    """Power of the one-way analysis of variance: the upper tail of a noncentral F as a Poisson mixture."""
    d1, d2 = groups - 1, groups * (n - 1)
    shift = (groups - 1) * n * between / within
    critical = special.inverse(lambda f: 1 - special.f_upper(f, d1, d2), 1 - level, 0.0, 1e4)
    x = d1 * critical / (d1 * critical + d2)
    total, k = 0.0, 0
    while k < 2000:
        weight = math.exp(-shift / 2 + (k * math.log(shift / 2) if shift else (0.0 if k == 0 else -math.inf)) - math.lgamma(k + 1))
        total += weight * special.beta_i(d1 / 2 + k, d2 / 2, x)
        if k > shift / 2 and weight < 1e-14:
            break
        k += 1
    return 1 - total


def sample_size(power, wanted: float, high: float = 1e7) -> float:
    """The n at which ``power(n)`` reaches the wanted power."""
    return special.inverse(power, wanted, 2.0, high)


def canonical_correlations(df: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """Canonical correlations of two sets of columns, from one matrix of products, with Bartlett's tests."""
    no_nulls(df, [*x, *y])
    row = df.agg(F.count("*"), *(F.avg(F.col(c).cast("double")) for c in [*x, *y])).first()
    n = row[0]
    s = products(df, [F.col(c).cast("double") - m for c, m in zip([*x, *y], row[1:], strict=True)])
    p, q = len(x), len(y)
    lx, ly = np.linalg.cholesky(s[:p, :p]), np.linalg.cholesky(s[p:, p:])
    r = np.clip(np.linalg.svd(np.linalg.solve(lx, s[:p, p:]) @ np.linalg.inv(ly).T, compute_uv=False), 0, 1)
    out = []
    for k in range(len(r)):
        stat, dof = -(n - 1 - (p + q + 1) / 2) * float(np.log(np.clip(1 - r[k:] ** 2, 1e-300, 1)).sum()), (p - k) * (q - k)
        out.append((k + 1, float(r[k]), stat, float(dof), special.chi2_upper(stat, dof)))
    return _frame(df.sparkSession, "component int, correlation double, statistic double, df double, p_value double", out)


def factor_analysis(df: DataFrame, columns: list[str], factors: int, rotate: bool = True, rounds: int = 2000, tolerance: float = 1e-10) -> DataFrame:
    """(variable, factor, loading, uniqueness): maximum likelihood by EM on the correlation matrix, varimax rotation."""
    no_nulls(df, columns)
    row = df.agg(*(f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)), F.count("*")).first()
    p = len(columns)
    r = products(df, [(F.col(c).cast("double") - row[2 * i]) / row[2 * i + 1] for i, c in enumerate(columns)]) / row[2 * p]
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, ::-1][:, :factors] * np.sqrt(np.clip(values[::-1][:factors] - 0.5, 0.05, None))
    psi = np.clip(1 - (load**2).sum(axis=1), 0.05, None)
    for _ in range(rounds):
        b = load.T @ np.linalg.inv(load @ load.T + np.diag(psi))
        new = r @ b.T @ np.linalg.inv(np.eye(factors) - b @ load + b @ r @ b.T)
        psi_new = np.clip(np.diag(r - new @ b @ r), 0.005, None)
        done = max(np.abs(new - load).max(), np.abs(psi_new - psi).max()) < tolerance
        load, psi = new, psi_new
        if done:
            break
    if rotate and factors > 1:
        load = load @ _varimax(load)
    load = load * np.where(load.sum(axis=0) < 0, -1, 1)
    load = load[:, np.argsort(-(load**2).sum(axis=0))]
    return _frame(df.sparkSession, "variable string, factor int, loading double, uniqueness double", [(c, k + 1, float(load[i, k]), float(psi[i])) for i, c in enumerate(columns) for k in range(factors)])


def _varimax(load: np.ndarray, rounds: int = 500) -> np.ndarray:
    p, turn, last = len(load), np.eye(load.shape[1]), 0.0
    scale = np.sqrt((load**2).sum(axis=1, keepdims=True))
    z = load / scale
    for _ in range(rounds):
        x = z @ turn
        u, s, v = np.linalg.svd(z.T @ (x**3 - x * (x**2).sum(axis=0) / p))
        turn = u @ v
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return turn


def interpolate(x: list[float], y: list[float], at: list[float], kind: str = "linear") -> list[float]:
    """Values between given points: linear, constant (from the left) or a natural cubic spline."""
    order = np.argsort(x)
    x, y, at = np.asarray(x, float)[order], np.asarray(y, float)[order], np.asarray(at, float)
    if kind == "linear":
        return np.interp(at, x, y).tolist()
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - (1 if kind == "constant" else 2))
    if kind == "constant":
        return y[k].tolist()
    h = np.diff(x)
    a = np.zeros((len(x), len(x)))
    a[0, 0] = a[-1, -1] = 1
    rhs = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, rhs)
    left, right = x[k + 1] - at, at - x[k]
    return ((m[k] * left**3 + m[k + 1] * right**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * left + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * right).tolist()


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    """The Jarque-Bera test of normality."""
    return stats.moments(df, column).select(F.col("jarque_bera").alias("statistic"), F.lit(2.0).alias("df"), "p_value")
