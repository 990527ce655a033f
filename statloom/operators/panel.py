"""Dynamic panels by generalised method of moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .moments import no_nulls

#: Periods that an entity may have; instruments grow with their square.
MAX_PERIODS = 60


def _design(values: np.ndarray, lags: int, depth: int, periods: int, places: np.ndarray):
    """First differences of one entity whose row k lies in period places[k]: (y, regressors, instruments, times, rows in step)."""
    y = np.full(periods, np.nan)
    x = np.full((periods, values.shape[1] - 1), np.nan)
    y[places], x[places] = values[:, 0], values[:, 1:]
    target, regress, instruments, times = [], [], [], []
    width = sum(min(depth, t - 1) for t in range(2, periods))
    start = 0
    for t in range(2, periods):
        wide = min(depth, t - 1)
        if t > lags and not np.isnan([*y[t - lags - 1 : t + 1], *x[t], *x[t - 1]]).any():
            z = np.zeros(width + x.shape[1])
            past = y[t - 1 - wide : t - 1]
            z[start : start + wide] = np.nan_to_num(past)
            z[width:] = x[t] - x[t - 1]
            target.append(y[t] - y[t - 1])
            regress.append([*(y[t - k] - y[t - k - 1] for k in range(1, lags + 1)), *(x[t] - x[t - 1])])
            instruments.append(z)
            times.append(t)
        start += wide
    return np.array(target), np.array(regress), np.array(instruments), np.array(times)


def _step(times: np.ndarray) -> np.ndarray:
    """Covariance of differenced white noise."""
    apart = np.abs(times[:, None] - times[None, :])
    return np.where(apart == 0, 2.0, np.where(apart == 1, -1.0, 0.0))


def arellano_bond(df: DataFrame, y: str, x: list[str], entity: str, period: str, lags: int = 1, depth: int = 99, steps: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """First-difference GMM: (term, estimate, std_error, statistic, p_value) with robust errors, and tests.

    Lags of y are instrumented by its levels at least two periods back (`depth` of them at most), strictly exogenous x by
    their own differences. Periods are the sorted distinct values of the column (at most MAX_PERIODS); gaps leave out the
    differences that need them. Each entity's products are summed by Spark, one pass a step; rows with nulls are refused,
    and so are repeated periods of an entity. The errors of two steps are not corrected for finite samples. Tests: Sargan's
    (one step) or Hansen's J with its degrees of freedom and p-value, and the serial correlation of differenced residuals
    of order 1 and 2 (m1, m2; without the correction for estimated coefficients) with p-values.
    """
    if steps not in (1, 2):
        raise ValueError("steps is 1 or 2")
    no_nulls(df, [y, *x, entity, period])
    found = [r[0] for r in df.select(period).distinct().orderBy(period).limit(MAX_PERIODS + 1).collect()]
    if len(found) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    if len(found) < lags + 2:
        raise ValueError(f"{lags} lags take at least {lags + 2} periods")
    place, n_t, columns = {p: i for i, p in enumerate(found)}, len(found), [y, *x]
    rows = df.select(F.col(entity).alias("__e"), F.col(period).alias("__t"), *(F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)))

    def parts(frame: pd.DataFrame):
        at = frame["__t"].map(place).to_numpy()
        if len(set(at)) < len(at):
            raise ValueError("a period repeats within an entity")
        return _design(frame[[f"__{i}" for i in range(len(columns))]].to_numpy(float), lags, depth, n_t, at)

    def total(products) -> list[np.ndarray]:
        """Sums over entities of what `products` returns for one; an entity is one task's, at most MAX_PERIODS rows."""

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            told = parts(frame)
            flat = [] if not len(told[0]) else [(i, j, float(v)) for i, a in enumerate(products(*told)) for j, v in enumerate(np.ravel(a)) if v]
            return pd.DataFrame(flat, columns=["which", "place", "value"]).astype({"which": "int32", "place": "int32", "value": "float64"})

        got = rows.groupBy("__e").applyInPandas(one, "which int, place int, value double").groupBy("which", "place").agg(F.sum("value").alias("value")).collect()  # the size of the instruments squared
        out = [np.zeros(s) for s in shapes]
        for r in got:
            out[r["which"]].flat[r["place"]] = r["value"]
        return out

    k, q = lags + len(x), sum(min(depth, t - 1) for t in range(2, n_t)) + len(x)
    shapes = [(q, k), (q,), (q, q), ()]
    zx, zy, weight, n = total(lambda d, r, z, t: (z.T @ r, z.T @ d, z.T @ _step(t) @ z, len(d)))
    if not n:
        raise ValueError("no entity has enough consecutive periods")

    def solve(w):
        bread = np.linalg.pinv(zx.T @ w @ zx)
        return bread @ zx.T @ w @ zy, bread

    w = np.linalg.pinv(weight)
    beta, bread = solve(w)
    shapes = [(q, q), (), (), (), (), (), ()]

    def residual_products(d, r, z, t):
        e = d - r @ beta
        score, lagged = z.T @ e, []
        for order in (1, 2):
            pairs = sum(e[i] * e[j] for i in range(len(t)) for j in range(len(t)) if t[i] - t[j] == order)
            lagged += [pairs, pairs**2]
        return (np.outer(score, score), e @ e, *lagged, 1)

    meat, rss, *correlated, _ = total(residual_products)
    if steps == 1:
        cov = bread @ zx.T @ w @ meat @ w @ zx @ bread
        score = zy - zx @ beta
        j = float(score @ w @ score / (rss / n / 2))
    else:
        w = np.linalg.pinv(meat)
        beta, bread = solve(w)
        cov = bread
        score = zy - zx @ beta
        j = float(score @ w @ score)
        correlated = total(residual_products)[2:6]
    dof = int(np.linalg.matrix_rank(weight)) - k
    tests = {"n": float(n), "instruments": float(np.linalg.matrix_rank(weight)), "j": j, "j_df": float(dof), "j_p_value": special.chi2_upper(j, dof) if dof > 0 else float("nan")}
    for order in (1, 2):
        value, square = (float(v) for v in correlated[2 * order - 2 : 2 * order])
        tests[f"m{order}"] = value / square**0.5 if square else float("nan")
        tests[f"m{order}_p_value"] = special.normal_two_sided(tests[f"m{order}"]) if square else float("nan")
    se = np.sqrt(np.diag(cov))
    names = [*(f"{y}_l{i}" for i in range(1, lags + 1)), *x]
    told = [(t, float(b), float(s), float(b / s), special.normal_two_sided(float(b / s))) for t, b, s in zip(names, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(told, "term string, estimate double, std_error double, statistic double, p_value double"), tests
