"""Distribution functions in plain Python, and a column form for rows of test statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def logistic_cdf(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def logistic_pdf(x: float) -> float:
    p = logistic_cdf(x)
    return p * (1 - p)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / _safe(an * d + b)
        c = _safe(b + an / c)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _safe(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction on the side where that converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / _safe(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _safe(1 + num * d)
            c = _safe(1 + num / c)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_upper(x: float) -> float:
    if x <= 0:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def inverse(cdf, p: float, low: float = -1e3, high: float = 1e3) -> float:
    """The point where an increasing function reaches ``p``."""
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_critical(df: float, level: float = 0.95) -> float:
    return inverse(lambda t: -t_two_sided(t, df), level - 1, 0.0, 1e4)


def normal_quantile(p: float) -> float:
    return inverse(normal_cdf, p, -40, 40)


def normal_quantile_of(q: Column, tail: Column) -> Column:
    """Normal quantile as a column, by Wichura's AS 241 (relative error 1e-16): ``q`` is p - 0.5, ``tail`` the smaller of p and 1 - p."""

    def ratio(r: Column, above: tuple, below: tuple) -> Column:
        num, den = F.lit(above[0]), F.lit(below[0])
        for a, b in zip(above[1:], below[1:], strict=True):
            num, den = num * r + a, den * r + b
        return num / den

    #: Wichura's coefficients of the middle, the tails and the far tails.
    middle = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608), (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
    outer = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734), (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
    far = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772), (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.1369298809227358053, 0.59983220655588793769, 1.0)
    r = F.sqrt(-F.ln(tail))
    side = F.when(r <= 5, ratio(r - 1.6, *outer)).otherwise(ratio(r - 5, *far))
    return F.when(F.abs(q) <= 0.425, ratio(0.180625 - q * q, *middle) * q).otherwise(F.when(q < 0, -side).otherwise(side))


DISTRIBUTIONS = {"t": t_two_sided, "chi2": chi2_upper, "f": f_upper, "z": normal_two_sided, "ks": kolmogorov_upper}


def p_value(distribution: str, statistic: Column, *df: Column) -> Column:
    """p-value column for rows of statistics (few rows by nature); null where the statistic is."""
    import pandas as pd

    def of(frame):
        f = DISTRIBUTIONS[distribution]
        return frame.apply(lambda r: f(*(float(v) for v in r)) if r.notna().all() and all(map(math.isfinite, r)) else None, axis=1).astype("float64")

    of.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(of, "double")(F.struct(*(c.cast("double").alias(f"_{i}") for i, c in enumerate((statistic, *df)))))


def f_critical(upper: float, df1: float, df2: float) -> float:
    """The value that an F variable exceeds with probability ``upper``."""
    return math.exp(inverse(lambda v: -f_upper(math.exp(v), df1, df2), -upper, -50, 50))


def t_limit(df: Column, level: float) -> Column:
    """t value that holds ``level`` of the distribution between its negative and itself (few rows by nature)."""
    import pandas as pd

    def of(d):
        return d.map(lambda v: t_critical(v, level) if v == v and v > 0 else None).astype("float64")

    of.__annotations__ = {"d": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "double")(df.cast("double"))


def adjust_p(p: list[float], method: str = "bh") -> list[float]:
    """Adjusted p-values: bonferroni, holm, hochberg, bh (fdr), by."""
    n = len(p)
    order = sorted(range(n), key=lambda i: p[i])
    ranked = [p[i] for i in order]
    harmonic = sum(1 / k for k in range(1, n + 1))
    if method == "bonferroni":
        out = [v * n for v in ranked]
    elif method == "holm":
        out, top = [], 0.0
        for k, v in enumerate(ranked):
            top = max(top, v * (n - k))
            out.append(top)
    elif method in ("hochberg", "bh", "fdr", "by"):
        scale = {"hochberg": lambda k: n - k, "by": lambda k: harmonic * n / (k + 1)}.get(method, lambda k: n / (k + 1))
        out, low = [0.0] * n, 1.0
        for k in range(n - 1, -1, -1):
            low = min(low, ranked[k] * scale(k))
            out[k] = low
    else:
        raise ValueError(f"unknown method {method!r}")
    back = [0.0] * n
    for k, i in enumerate(order):
        back[i] = min(1.0, out[k])
    return back
