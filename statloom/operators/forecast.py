"""Models of single series: a series is ordered and small by nature, so it is fitted in one task; groups of series run side by side."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special

#: Values of a series that a task takes at most; longer ones are refused.
MAX_LENGTH = 1_000_000


def by_series(df: DataFrame, value: str, order_by: list[str], series_id: list[str], schema: str, fit: Callable) -> DataFrame:
    """``fit(values)`` of each series, a list of rows of ``schema``, after the series' id."""
    import pandas as pd

    kinds = dict(df.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_LENGTH:
            raise ValueError(f"a series of more than {MAX_LENGTH} values")
        x = pdf.sort_values(order_by)[value].astype(float).to_numpy()
        out = pd.DataFrame(fit(x), columns=names)
        for i, c in enumerate(series_id):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    head = ", ".join(f"`{c}` {kinds[c]}" for c in series_id)
    return df.groupBy(*series_id).applyInPandas(run, f"{head}, {schema}" if head else schema)


def autocovariance(x: np.ndarray, lags: int) -> np.ndarray:
    z = x - x.mean()
    return np.array([z[k:] @ z[: len(z) - k] for k in range(lags + 1)]) / len(z)


def yule_walker(c: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Autoregressive coefficients and innovation variance from autocovariances."""
    if order == 0:
        return np.zeros(0), float(c[0])
    r = np.array([[c[abs(i - j)] for j in range(order)] for i in range(order)])
    a = np.linalg.solve(r, c[1 : order + 1])
    return a, float(c[0] - a @ c[1 : order + 1])


def fit_ar(x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, float, int]:
    """Autoregression of the order of least AIC."""
    n = len(x)
    most = min(n - 1, int(10 * math.log10(n))) if most is None else most
    c = autocovariance(x, most)
    aic = [n * math.log(max(yule_walker(c, p)[1], 1e-300)) + 2 * p for p in range(most + 1)]
    p = int(np.argmin(aic))
    a, v = yule_walker(c, p)
    return a, v * n / max(1, n - p - 1), p


def ar(df: DataFrame, value: str, order_by: list[str], series_id: list[str], most: int | None = None) -> DataFrame:
    """(lag, coefficient, variance): autoregression of each series by Yule and Walker."""

    def fit(x):
        a, v, _ = fit_ar(x, most)
        return [(0, float(x.mean()), v), *((k + 1, float(c), v) for k, c in enumerate(a))]

    return by_series(df, value, order_by, series_id, "lag int, coefficient double, variance double", fit)


def _residuals(x: np.ndarray, phi: np.ndarray, theta: np.ndarray, mean: float) -> np.ndarray:
    """Conditional one-step errors of an ARMA model."""
    z, p, q = x - mean, len(phi), len(theta)
    e = np.zeros(len(z))
    u = z.copy()
    for i in range(p):
        u[i + 1 :] -= phi[i] * z[: len(z) - i - 1]
    if not q:
        e = u
    else:
        for t in range(len(z)):
            e[t] = u[t] - sum(theta[j] * e[t - j - 1] for j in range(min(q, t)))
    return e[p:]


def _least(f: Callable, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least squares of a vector function by Levenberg and Marquardt."""
    t, damp = start.astype(float), 1e-3
    r = f(t)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(t), 1e-2)
        j = np.column_stack([(f(t + d) - f(t - d)) / (2 * h[i]) for i, d in enumerate(np.diag(h))])
        a, g = j.T @ j, j.T @ r
        while True:
            new = t - np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
            s = f(new)
            if np.isfinite(s).all() and s @ s <= r @ r:
                break
            damp *= 10
            if damp > 1e12:
                return t
        done = np.abs(new - t).max() < 1e-8 * max(1.0, np.abs(t).max())
        t, r, damp = new, s, max(damp / 10, 1e-12)
        if done:
            break
    return t


def fit_arima(x: np.ndarray, p: int, d: int, q: int, constant: bool | None = None):
    """Conditional least squares: (phi, theta, mean, variance, differenced series, errors)."""
    z = np.diff(x, d) if d else x
    constant = d == 0 if constant is None else constant
    start = np.concatenate([fit_ar(z, p)[0] if p and len(fit_ar(z, p)[0]) == p else np.full(p, 0.1), np.full(q, 0.1), [z.mean()] if constant else []])
    split = lambda t: (t[:p], t[p : p + q], float(t[-1]) if constant else 0.0)
    t = _least(lambda v: np.clip(np.nan_to_num(_residuals(z, *split(v)), nan=1e6, posinf=1e6, neginf=-1e6), -1e9, 1e9), start) if len(start) else start
    phi, theta, mean = split(t)
    e = _residuals(z, phi, theta, mean)
    return phi, theta, mean, float(e @ e / len(e)), z, e


def arma_to_ma(phi: np.ndarray, theta: np.ndarray, lags: int) -> np.ndarray:
    """The moving-average weights of an ARMA model, from lag 1."""
    psi = np.zeros(lags + 1)
    psi[0] = 1
    for k in range(1, lags + 1):
        psi[k] = (theta[k - 1] if k <= len(theta) else 0.0) + sum(phi[i] * psi[k - i - 1] for i in range(min(k, len(phi))))
    return psi[1:]


def arma_acf(phi: np.ndarray, theta: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations of an ARMA model, by its moving-average weights."""
    psi = np.concatenate([[1.0], arma_to_ma(np.asarray(phi), np.asarray(theta), 2000 + lags)])
    c = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(lags + 1)])
    return c / c[0]


def simulate_arma(n: int, phi, theta, sd: float = 1.0, seed: int = 0) -> np.ndarray:
    e = np.random.default_rng(seed).normal(scale=sd, size=n + 500)
    x = np.zeros(n + 500)
    for t in range(n + 500):
        x[t] = e[t] + sum(a * x[t - i - 1] for i, a in enumerate(phi) if t > i) + sum(b * e[t - j - 1] for j, b in enumerate(theta) if t > j)
    return x[500:]


def arima(df: DataFrame, value: str, order_by: list[str], series_id: list[str], order: tuple[int, int, int], horizon: int = 10, level: float = 0.95) -> DataFrame:
    """(step, forecast, low, high, variance, aic) of each series."""
    p, d, q = order
    z_ = special.normal_quantile((1 + level) / 2)

    def fit(x):
        phi, theta, mean, v, z, e = fit_arima(x, p, d, q)
        past, errors, out = list(z - mean), list(e), []
        for _ in range(horizon):
            past.append(sum(a * past[-i - 1] for i, a in enumerate(phi)) + sum(b * errors[-j - 1] for j, b in enumerate(theta)))
            errors.append(0.0)
            out.append(past[-1] + mean)
        path, weights = np.array(out), np.concatenate([[1.0], arma_to_ma(phi, theta, horizon)])[:horizon]
        for k in range(d):
            path = np.cumsum(path) + np.diff(x, d - 1 - k)[-1]
            weights = np.cumsum(weights)
        sd = np.sqrt(v * np.cumsum(weights**2))
        aic = len(e) * (math.log(2 * math.pi * v) + 1) + 2 * (p + q + (d == 0) + 1)
        return [(k + 1, float(f), float(f - z_ * s), float(f + z_ * s), v, aic) for k, (f, s) in enumerate(zip(path, sd, strict=True))]

    return by_series(df, value, order_by, series_id, "step int, forecast double, low double, high double, variance double, aic double", fit)


def _loess1(y: np.ndarray, width: int, at: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Local lines over equally spaced values, at given places."""
    n, out = len(y), np.empty(len(at))
    w = np.ones(n) if w is None else w
    for k, p in enumerate(at):
        low = int(min(max(0, math.ceil(p - width / 2)), max(0, n - width)))
        part = slice(low, min(n, low + width))
        x = np.arange(n)[part] - p
        reach = max(np.abs(x).max() * (1 if width <= n else width / n), 1.0) * 1.001
        u = w[part] * (1 - np.abs(x / reach) ** 3) ** 3
        m, v = (u * x).sum() / u.sum(), (u * y[part]).sum() / u.sum()
        s = (u * (x - m) ** 2).sum()
        out[k] = v - m * ((u * (x - m) * (y[part] - v)).sum() / s if s > 1e-12 else 0.0)
    return out


def decompose_loess(x: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and remainder by loess of the cycle's places and of the rest."""
    n = len(x)
    trend, weight = np.zeros(n), np.ones(n)
    width = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    for o in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                sub = (x - trend)[k::period]
                cycle[k::period] = _loess1(sub, seasonal, np.arange(-1, len(sub) + 1), weight[k::period])[: len(cycle[k::period])]
            low = cycle
            for m in (period, period, 3):
                low = np.convolve(low, np.ones(m) / m, "valid")
            season = cycle[period : period + n] - _loess1(low, period | 1, np.arange(n))
            trend = _loess1(x - season, width, np.arange(n), weight)
        r = np.abs(x - trend - season)
        h = 6 * np.median(r)
        weight = np.clip(1 - (r / h) ** 2, 0, 1) ** 2 if h > 0 else weight
    return trend, season, x - trend - season


def stl(df: DataFrame, value: str, order_by: list[str], series_id: list[str], period: int, seasonal: int = 7, robust: bool = False) -> DataFrame:
    """(place, trend, seasonal, remainder) of each series."""

    def fit(x):
        t, s, r = decompose_loess(x, period, seasonal, 2, 5 if robust else 0)
        return [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, s, r, strict=True))]

    return by_series(df, value, order_by, series_id, "place int, trend double, seasonal double, remainder double", fit)


def mstl(df: DataFrame, value: str, order_by: list[str], series_id: list[str], periods: list[int], rounds: int = 2) -> DataFrame:
    """(place, period, seasonal, trend): several seasons, each taken out of the others' remainder in turn."""

    def fit(x):
        seasons = {p: np.zeros(len(x)) for p in sorted(periods)}
        trend = np.zeros(len(x))
        for _ in range(rounds):
            for p in seasons:
                rest = x - sum(s for q, s in seasons.items() if q != p)
                trend, seasons[p], _ = decompose_loess(rest, p, 11)
        return [(i, p, float(s[i]), float(trend[i])) for p, s in seasons.items() for i in range(len(x))]

    return by_series(df, value, order_by, series_id, "place int, period int, seasonal double, trend double", fit)


def change_points(x: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Starts of segments of different means, by exact search with pruning."""
    n = len(x)
    v = np.median(np.abs(np.diff(x))) / 0.6745 / math.sqrt(2) if n > 2 else 0.0
    penalty = 3 * math.log(max(n, 2)) * (v * v or x.var() or 1.0) if penalty is None else penalty
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    best, last, alive = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.array([0])
    best[0] = -penalty
    for t in range(least, n + 1):
        ok = alive[alive <= t - least]
        cost = best[ok] + q[t] - q[ok] - (s[t] - s[ok]) ** 2 / (t - ok)
        k = int(cost.argmin())
        best[t], last[t] = cost[k] + penalty, ok[k]
        alive = np.concatenate([ok[cost <= best[t]], alive[alive > t - least], [t]])
    out, t = [], n
    while last[t] > 0:
        t = int(last[t])
        out.append(t)
    return out[::-1]


def binary_segmentation(x: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Starts of segments of different means, one best split at a time."""
    v = np.median(np.abs(np.diff(x))) / 0.6745 / math.sqrt(2) if len(x) > 2 else 0.0
    penalty = 3 * math.log(max(len(x), 2)) * (v * v or x.var() or 1.0) if penalty is None else penalty
    out, todo = [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        z = x[a:b]
        if len(z) < 2 * least:
            continue
        s, k = np.cumsum(z), np.arange(1, len(z))
        gain = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (len(z) - k) - s[-1] ** 2 / len(z)
        gain[: least - 1], gain[len(gain) - least + 1 :] = -np.inf, -np.inf
        m = int(gain.argmax())
        if gain[m] > penalty:
            out.append(a + m + 1)
            todo += [(a, a + m + 1), (a + m + 1, b)]
    return sorted(out)


def changes(df: DataFrame, value: str, order_by: list[str], series_id: list[str], method: str = "exact", penalty: float | None = None) -> DataFrame:
    """(place, before, after): where the mean of each series changes."""

    def fit(x):
        at = (change_points if method == "exact" else binary_segmentation)(x, penalty)
        ends = [0, *at, len(x)]
        return [(p, float(x[ends[i] : p].mean()), float(x[p : ends[i + 2]].mean())) for i, p in enumerate(at)]

    return by_series(df, value, order_by, series_id, "place int, before double, after double", fit)


def kalman(y: np.ndarray, t: np.ndarray, z: np.ndarray, q: np.ndarray, h: float, a: np.ndarray, p: np.ndarray, smooth: bool = False) -> dict:
    """Filter (and smoother) of a linear state space model with one series; missing values are skipped."""
    n, m = len(y), len(a)
    states, spread, ahead, wide, ll = np.zeros((n, m)), np.zeros((n, m, m)), np.zeros((n, m)), np.zeros((n, m, m)), 0.0
    for i in range(n):
        ahead[i], wide[i] = a, p
        if not np.isnan(y[i]):
            e, f = y[i] - z @ a, float(z @ p @ z + h)
            k = p @ z / f
            a, p = a + k * e, p - np.outer(k, z @ p)
            ll -= 0.5 * (math.log(2 * math.pi * f) + e * e / f)
        states[i], spread[i] = a, p
        a, p = t @ a, t @ p @ t.T + q
    out = {"filtered": states, "variance": spread, "log_likelihood": ll, "next": (a, p)}
    if smooth:
        s, v = states.copy(), spread.copy()
        for i in range(n - 2, -1, -1):
            j = spread[i] @ t.T @ np.linalg.pinv(wide[i + 1])
            s[i] = states[i] + j @ (s[i + 1] - ahead[i + 1])
            v[i] = spread[i] + j @ (v[i + 1] - wide[i + 1]) @ j.T
        out |= {"smoothed": s, "smoothed_variance": v}
    return out


def _simplex(f: Callable, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Downhill simplex."""
    k = len(start)
    p = np.vstack([start, *(start + np.eye(k)[i] for i in range(k))])
    v = np.array([f(x) for x in p])
    for _ in range(rounds):
        o = np.argsort(v)
        p, v = p[o], v[o]
        if v[-1] - v[0] < 1e-10 * (abs(v[0]) + 1e-10):
            break
        c = p[:-1].mean(axis=0)
        r = c + (c - p[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + 2 * (c - p[-1])
            fe = f(e)
            p[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            p[-1], v[-1] = r, fr
        else:
            s = c + 0.5 * ((r if fr < v[-1] else p[-1]) - c)
            fs = f(s)
            if fs < min(fr, v[-1]):
                p[-1], v[-1] = s, fs
            else:
                p[1:] = p[0] + 0.5 * (p[1:] - p[0])
                v[1:] = [f(x) for x in p[1:]]
    return p[v.argmin()]


def structural(df: DataFrame, value: str, order_by: list[str], series_id: list[str], trend: bool = False) -> DataFrame:
    """(place, level, slope, noise, level_noise): local level or local linear trend of each series, variances by maximum likelihood."""

    def fit(x):
        s = x.std() or 1.0
        y, m = (x - x[0]) / s, 2 if trend else 1
        t, z = (np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0])) if trend else (np.eye(1), np.ones(1))
        run = lambda v, smooth=False: kalman(y, t, z, np.diag(np.exp(np.clip(v[1:], -30, 30))), math.exp(min(max(v[0], -30), 30)), np.zeros(m), 1e4 * np.eye(m), smooth)
        v = _simplex(lambda v: -run(v)["log_likelihood"], np.full(m + 1, -2.0))
        got = run(v, True)["smoothed"]
        return [(i, float(r[0] * s + x[0]), float(r[1] * s) if trend else 0.0, math.exp(v[0]) * s * s, math.exp(v[1]) * s * s) for i, r in enumerate(got)]

    return by_series(df, value, order_by, series_id, "place int, level double, slope double, noise double, level_noise double", fit)


def garch(df: DataFrame, value: str, order_by: list[str], series_id: list[str], horizon: int = 5) -> DataFrame:
    """(step, variance, omega, alpha, beta): GARCH(1,1) of each series by maximum likelihood, and its variance forecasts."""

    def fit(x):
        e = x - x.mean()
        v0 = e.var() or 1.0

        def path(t):
            a, b = 1 / (1 + math.exp(-t[0])), 1 / (1 + math.exp(-t[1]))
            alpha, beta = a * (1 - b), b * 0.9999
            h = np.empty(len(e) + 1)
            h[0] = v0
            omega = v0 * max(1e-6, 1 - alpha - beta)
            for i in range(len(e)):
                h[i + 1] = omega + alpha * e[i] ** 2 + beta * h[i]
            return h, omega, alpha, beta

        def loss(t):
            h = path(np.clip(t, -20, 20))[0][:-1]
            return 0.5 * float((np.log(h) + e**2 / h).sum())

        h, omega, alpha, beta = path(np.clip(_simplex(loss, np.array([-2.0, 1.5])), -20, 20))
        out, v = [], h[-1]
        for k in range(horizon):
            out.append((k + 1, float(v), float(omega), float(alpha), float(beta)))
            v = omega + (alpha + beta) * v
        return out

    return by_series(df, value, order_by, series_id, "step int, variance double, omega double, alpha double, beta double", fit)


def spectrum(df: DataFrame, value: str, order_by: list[str], series_id: list[str], taper: float = 0.1) -> DataFrame:
    """(frequency, density): periodogram of each detrended, tapered series."""

    def fit(x):
        n = len(x)
        t = np.arange(n) - (n - 1) / 2
        z = x - x.mean() - t * (t @ x) / (t @ t) if n > 2 else x - x.mean()
        m = int(n * taper)
        w = np.ones(n)
        if m:
            w[:m] = 0.5 * (1 - np.cos(np.pi * (2 * np.arange(m) + 1) / (2 * m)))
            w[n - m :] = w[:m][::-1]
        p = np.abs(np.fft.rfft(z * w)) ** 2 / n / (1 - 5 / 8 * taper * 2)
        return [(float(k / n), float(p[k])) for k in range(1, len(p))]

    return by_series(df, value, order_by, series_id, "frequency double, density double", fit)


def spectrum_ar(df: DataFrame, value: str, order_by: list[str], series_id: list[str], points: int = 200) -> DataFrame:
    """(frequency, density): spectrum of the fitted autoregression."""

    def fit(x):
        a, v, _ = fit_ar(x)
        f = np.linspace(0, 0.5, points)
        poly = 1 - sum((c * np.exp(-2j * np.pi * f * (k + 1)) for k, c in enumerate(a)), np.zeros(points))
        return [(float(u), float(v / abs(p) ** 2)) for u, p in zip(f, poly, strict=True)]

    return by_series(df, value, order_by, series_id, "frequency double, density double", fit)


def white_noise(df: DataFrame, value: str, order_by: list[str], series_id: list[str]) -> DataFrame:
    """(statistic, p_value): Bartlett's test by the cumulative periodogram."""

    def fit(x):
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2
        p = p[1 : (len(x) - 1) // 2 + 1]
        c = np.cumsum(p) / p.sum()
        m = len(p)
        d = float(np.abs(c - np.arange(1, m + 1) / m).max())
        return [(d, special.kolmogorov_upper(math.sqrt(m) * d))]

    return by_series(df, value, order_by, series_id, "statistic double, p_value double", fit)


def phillips_perron(df: DataFrame, value: str, order_by: list[str], series_id: list[str], lags: int | None = None) -> DataFrame:
    """(z_tau, z_rho, lags): unit root test with a constant of each series; values below about -2.86 reject at 5 %."""

    def fit(x):
        y, z = x[1:], np.column_stack([np.ones(len(x) - 1), x[:-1]])
        inv = np.linalg.inv(z.T @ z)
        b = inv @ z.T @ y
        e = y - z @ b
        n = len(y)
        m = int(4 * (n / 100) ** 0.25) if lags is None else lags
        s2 = float(e @ e / (n - 2))
        g = [float(e[k:] @ e[: n - k] / n) for k in range(m + 1)]
        long = g[0] + 2 * sum((1 - k / (m + 1)) * g[k] for k in range(1, m + 1))
        se = math.sqrt(s2 * inv[1, 1])
        t = (b[1] - 1) / se
        return [(float(math.sqrt(g[0] / long) * t - (long - g[0]) * n * se / (2 * math.sqrt(long * s2))), float(n * (b[1] - 1) - n * n * se * se / s2 * (long - g[0]) / 2), m)]

    return by_series(df, value, order_by, series_id, "z_tau double, z_rho double, lags int", fit)


def causal_impact(df: DataFrame, value: str, controls: list[str], order_by: list[str], start, level: float = 0.95) -> DataFrame:
    """(average, low, high, total, p_value): the effect from ``start`` on, against a regression on control series fitted before."""
    from .moments import ONE, ols

    (at,) = order_by
    before, after = df.where(F.col(at) < F.lit(start)), df.where(F.col(at) >= F.lit(start))
    fit = ols(before, value, controls)
    z = sum((float(b) * (F.lit(1.0) if t == ONE else F.col(t).cast("double")) for t, b in zip(fit.names, fit.coef, strict=True)), F.lit(0.0))
    row = after.agg(F.sum(F.col(value) - z).alias("total"), F.count("*").alias("n"), *(F.avg(F.lit(1.0) if t == ONE else F.col(t).cast("double")).alias(f"m{i}") for i, t in enumerate(fit.names))).first()
    m = np.array([row[f"m{i}"] for i in range(len(fit.names))])
    se = math.sqrt(fit.rss / fit.df / row["n"] + float(m @ fit.vcov @ m))
    mean, wide = row["total"] / row["n"], special.t_critical(fit.df, level)
    return df.sparkSession.createDataFrame([(mean, mean - wide * se, mean + wide * se, float(row["total"]), special.t_two_sided(mean / se, fit.df))], "average double, low double, high double, total double, p_value double")


def embedded(df: DataFrame, column: str, order_by: list[str], dimension: int, series_id: list[str]) -> DataFrame:
    """``df`` with the ``dimension`` - 1 values before each one (lag1, ...), without the rows that lack them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*series_id).orderBy(*order_by)
    return df.withColumns({f"lag{k}": F.lag(column, k).over(w) for k in range(1, dimension)}).dropna(subset=[f"lag{k}" for k in range(1, dimension)])


def linear_filter(df: DataFrame, value: str, order_by: list[str], series_id: list[str], weights: list[float], recursive: bool = False) -> DataFrame:
    """(place, filtered): moving sums of weights centred on each value, or a recursion on the filtered values before."""

    def fit(x):
        if recursive:
            out = np.zeros(len(x))
            for t in range(len(x)):
                out[t] = x[t] + sum(w * out[t - k - 1] for k, w in enumerate(weights) if t > k)
            return [(i, float(v)) for i, v in enumerate(out)]
        k, half = len(weights), len(weights) // 2
        return [(i, float(sum(w * x[i + half - j] for j, w in enumerate(weights))) if 0 <= i + half - k + 1 and i + half < len(x) else None) for i in range(len(x))]

    return by_series(df, value, order_by, series_id, "place int, filtered double", fit)


def impulse_responses(coefficients: list[np.ndarray], covariance: np.ndarray, horizon: int, orthogonal: bool = True) -> np.ndarray:
    """Responses [step, variable, shock] of a vector autoregression with lag matrices."""
    k = len(covariance)
    psi = [np.eye(k)]
    for h in range(1, horizon + 1):
        psi.append(sum(a @ psi[h - i - 1] for i, a in enumerate(coefficients) if i < h))
    return np.array(psi) @ (np.linalg.cholesky(covariance) if orthogonal else np.eye(k))


def cointegration(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """(rank, eigenvalue, trace): Johansen's trace statistics of a first-order error-correction model with a constant."""
    from pyspark.sql import Window

    from .ordering import INDEX, indexed
    from .series import SPAN

    rows = indexed(df.select(*dict.fromkeys([*columns, *order_by])), order_by)
    block = F.floor(F.col(INDEX) / SPAN)
    rows = rows.withColumn("__b", F.explode(F.array_distinct(F.array(block, F.floor((F.col(INDEX) + 1) / SPAN))))).withColumn("__home", block == F.col("__b"))
    w = Window.partitionBy("__b").orderBy(INDEX)
    k = len(columns)
    rows = rows.withColumns({f"__l{i}": F.lag(F.col(c).cast("double")).over(w) for i, c in enumerate(columns)}).where("__home").dropna(subset=["__l0"])
    every = [*(F.col(c).cast("double") - F.col(f"__l{i}") for i, c in enumerate(columns)), *(F.col(f"__l{i}") for i in range(k))]
    from .moments import products

    rows = rows.select(*(e.alias(f"v{i}") for i, e in enumerate(every)))
    head = rows.agg(F.count("*"), *(F.avg(f"v{i}") for i in range(2 * k))).first()
    s = products(rows, [F.col(f"v{i}") - head[i + 1] for i in range(2 * k)]) / head[0]
    s00, s01, s11 = s[:k, :k], s[:k, k:], s[k:, k:]
    values = np.sort(np.clip(np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))).real, 0, 1 - 1e-12))[::-1]
    return df.sparkSession.createDataFrame([(r, float(values[r]), float(-head[0] * np.log(1 - values[r:]).sum())) for r in range(k)], "rank int, eigenvalue double, trace double")
