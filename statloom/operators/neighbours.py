"""Clusterings and maps from all distances of a bounded set (`cluster.MAX_POINTS`), and one of mixed columns for any number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import _told, distances, points


def optics(df: DataFrame, x: list[str], id_col: str, neighbours: int = 5, radius: float = float("inf")) -> DataFrame:
    """(id, place, reach, core): rows in the order of density reachability; reach is null at the start of a component.
    A row's core distance is that of its `neighbours`-th nearest row, itself counted; ties go to the earlier id."""
    ids, z = points(df, x, id_col)
    d, n = distances(z), len(ids)
    core = np.sort(d, axis=1)[:, min(neighbours, n) - 1] if n else np.zeros(0)
    core = np.where((core <= radius) & (neighbours <= n), core, np.inf)
    reach, done, out = np.full(n, np.inf), np.zeros(n, bool), []
    for place in range(n):
        open_ = np.where(done, np.inf, reach)
        i = int(open_.argmin()) if np.isfinite(open_).any() else int(np.flatnonzero(~done)[0])
        done[i] = True
        out.append((ids[i], place, float(reach[i]) if np.isfinite(reach[i]) else None, float(core[i]) if np.isfinite(core[i]) else None))
        if np.isfinite(core[i]):
            near = (d[i] <= radius) & ~done
            reach[near] = np.minimum(reach[near], np.maximum(core[i], d[i][near]))
    return df.sparkSession.createDataFrame(out, f"`{id_col}` {dict(df.dtypes)[id_col]}, place int, reach double, core double")


def affinity_propagation(df: DataFrame, x: list[str], id_col: str, preference: float | None = None, damping: float = 0.7, rounds: int = 500, settled: int = 20) -> DataFrame:
    """(id, cluster): exemplars by messages between rows; the preference is the median similarity unless it is given.
    Raises if the exemplars don't settle."""
    ids, z = points(df, x, id_col)
    n = len(ids)
    if n < 2:
        return _told(df, id_col, ids, [0] * n)
    s = -(distances(z) ** 2)
    apart = s[~np.eye(n, dtype=bool)]
    np.fill_diagonal(s, np.median(apart) if preference is None else preference)
    s = s + 1e-12 * np.abs(apart).max() * np.random.default_rng(0).random((n, n))
    r, a, last, same = np.zeros((n, n)), np.zeros((n, n)), None, 0
    every = np.arange(n)
    for _ in range(rounds):
        m = a + s
        best = m.argmax(axis=1)
        first = m[every, best].copy()
        m[every, best] = -np.inf
        rival = np.repeat(first[:, None], n, axis=1)
        rival[every, best] = m.max(axis=1)
        r = damping * r + (1 - damping) * (s - rival)
        plus = np.maximum(r, 0)
        plus[every, every] = r[every, every]
        told = plus.sum(axis=0)[None, :] - plus
        own = told[every, every].copy()
        told = np.minimum(told, 0)
        told[every, every] = own
        a = damping * a + (1 - damping) * told
        chosen = tuple(np.flatnonzero((a + r)[every, every] > 0))
        same = same + 1 if chosen == last and chosen else 0
        last = chosen
        if same >= settled:
            of = s[:, chosen].argmax(axis=1)
            of[list(chosen)] = np.arange(len(chosen))
            return _told(df, id_col, ids, of)
    raise RuntimeError(f"not settled after {rounds} rounds")


def diana(df: DataFrame, x: list[str], id_col: str, k: int) -> DataFrame:
    """(id, cluster): the cluster of the largest diameter is split until there are k; a split starts with the row farthest
    from the others on average, and rows follow while they are nearer to it than to the rest."""
    ids, z = points(df, x, id_col)
    d, of = distances(z), np.zeros(len(ids), int)
    for new in range(1, min(k, len(ids))):
        wide = [d[np.ix_(of == c, of == c)].max() for c in range(new)]
        inside = np.flatnonzero(of == int(np.argmax(wide)))
        if len(inside) < 2 or max(wide) == 0:
            break
        part = d[np.ix_(inside, inside)]
        left = np.zeros(len(inside), bool)
        left[part.sum(axis=1).argmax()] = True
        while (~left).sum() > 1:
            rest = np.flatnonzero(~left)
            gain = part[np.ix_(rest, rest)].sum(axis=1) / (len(rest) - 1) - part[np.ix_(rest, left)].mean(axis=1)
            if gain.max() <= 0:
                break
            left[rest[gain.argmax()]] = True
        of[inside[left]] = new
    return _told(df, id_col, ids, of)


def tsne(df: DataFrame, x: list[str], id_col: str, perplexity: float = 30.0, rounds: int = 500, rate: float | None = None, seed: int = 1) -> DataFrame:
    """(id, a, b): rows in the plane, near ones near, by exact gradients with momentum and early exaggeration."""
    ids, z = points(df, x, id_col)
    n = len(ids)
    if n < 4 or perplexity * 3 > n - 1:
        raise ValueError("t-SNE takes more than three times as many rows as the perplexity")
    d2 = distances(z) ** 2
    p = np.zeros((n, n))
    for i in range(n):
        others = np.delete(d2[i], i)
        others, low, high, beta = others - others.min(), 0.0, np.inf, 1.0 / max(np.median(others), 1e-12)
        for _ in range(100):
            w = np.exp(-others * beta)
            entropy = np.log(w.sum()) + beta * (others * w).sum() / w.sum()
            if abs(entropy - np.log(perplexity)) < 1e-6:
                break
            low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, step, gain = np.random.default_rng(seed).normal(0, 1e-4, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    rate = rate or max(n / 12, 50.0)
    for k in range(rounds):
        near = 1 / (1 + distances(y) ** 2)
        np.fill_diagonal(near, 0)
        w = ((12.0 if k < rounds // 4 else 1.0) * p - np.maximum(near / near.sum(), 1e-12)) * near
        slope = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(slope) == np.sign(step), gain * 0.8, gain + 0.2), 0.01)
        step = (0.5 if k < rounds // 4 else 0.8) * step - rate * gain * slope
        y = y + step
        y = y - y.mean(axis=0)
    return df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, y, strict=True)], f"`{id_col}` {dict(df.dtypes)[id_col]}, a double, b double")


def kprototypes(df: DataFrame, numbers: list[str], categories: list[str], id_col: str, k: int, weight: float | None = None, seed: int = 1, rounds: int = 50) -> DataFrame:
    """(id, cluster) of any number of rows: squared distances of numbers plus `weight` (half the numbers' mean standard
    deviation unless given) per differing category. A round is two aggregates: means, and the most frequent category of
    each cluster. Rows with a null number are left out; null is a category of its own."""
    cols = [F.col(c).cast("double") for c in numbers]
    rows = df.where(F.lit(True) if not numbers else ~F.greatest(F.lit(False), *(c.isNull() for c in cols))).select(F.col(id_col), *(c.alias(f"__n{i}") for i, c in enumerate(cols)), *(F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(categories)))
    n_cols, c_cols = [f"__n{i}" for i in range(len(numbers))], [f"__c{i}" for i in range(len(categories))]
    if weight is None:
        spread = rows.agg(*(F.stddev_pop(c) for c in n_cols)).first() if n_cols else [2.0]
        weight = float(np.mean([v or 0.0 for v in spread])) / 2
    start = rows.select(*n_cols, *c_cols).distinct().orderBy(F.xxhash64(F.lit(seed), *n_cols, *c_cols)).limit(k).collect()  # k rows
    centres = [tuple(r) for r in start]
    if len(centres) < k:
        raise ValueError(f"fewer than {k} distinct rows")

    def nearest():
        far = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(n_cols, m, strict=False)), F.lit(0.0)) + sum((F.when(F.col(c).eqNullSafe(F.lit(v)), 0.0).otherwise(weight) for c, v in zip(c_cols, m[len(n_cols):], strict=True)), F.lit(0.0)) for m in centres]
        return rows.withColumn("cluster", F.array_min(F.array(*(F.struct(f.alias("d"), F.lit(i).alias("i")) for i, f in enumerate(far))))["i"])

    for _ in range(rounds):
        told = nearest()
        means = {r["cluster"]: r for r in told.groupBy("cluster").agg(F.count("*"), *(F.avg(c).alias(c) for c in n_cols)).collect()}  # k rows
        modes: dict = {}
        for i, c in enumerate(c_cols):
            top = told.groupBy("cluster", c).agg(F.count("*").alias("__k")).groupBy("cluster").agg(F.min_by(c, F.struct(-F.col("__k"), F.coalesce(F.col(c), F.lit("")))).alias("top"))
            modes[i] = {r["cluster"]: r["top"] for r in top.collect()}  # k rows
        new = [tuple([means[j][c] for c in n_cols] + [modes[i][j] for i in range(len(c_cols))]) if j in means else centres[j] for j in range(k)]
        still = all(a == b if isinstance(a, str) or a is None or b is None else abs(a - b) <= 1e-9 * max(1.0, abs(a)) for m, o in zip(new, centres, strict=True) for a, b in zip(m, o, strict=True))
        centres = new
        if still:
            return nearest().select(id_col, "cluster")
    raise RuntimeError(f"not settled after {rounds} rounds")
