"""Models without SQL, against numpy on simulated rows."""

import numpy as np
import pytest

from statloom.operators import causal, cluster, learn, models, series


def logistic(x, d, rounds=50):
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (d - p))
    return 1 / (1 + np.exp(-x @ b))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n) + 2
    d = (rng.random(n) < 1 / (1 + np.exp(-0.5 * a))).astype(float)
    y = 1 + 2 * a - 0.5 * b + 1.5 * d + rng.normal(size=n)
    t = np.ceil(10 * rng.exponential(size=n) * np.exp(-0.4 * a))
    e = (rng.random(n) < 0.7).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, d, y, t, e, strict=True))]
    return {"n": n, "a": a, "b": b, "d": d, "y": y, "t": t, "e": e}, spark.createDataFrame(rows, "id long, a double, b double, d double, y double, t double, e double").cache()


def test_weighted_effects(data):
    v, df = data
    x = np.column_stack([np.ones(v["n"]), v["a"], v["b"]])
    p, d, y = np.clip(logistic(x, v["d"]), 0.01, 0.99), v["d"], v["y"]
    weights = {"ate": (d / p, (1 - d) / (1 - p)), "att": (d, (1 - d) * p / (1 - p)), "atc": (d * (1 - p) / p, 1 - d)}
    for kind, (w1, w0) in weights.items():
        assert causal.ipw(df, "y", "d", ["a", "b"], kind).first()["effect"] == pytest.approx((w1 @ y) / w1.sum() - (w0 @ y) / w0.sum(), abs=1e-6)
    m1, m0 = (x @ np.linalg.lstsq(x[d == k], y[d == k], rcond=None)[0] for k in (1, 0))
    score = m1 - m0 + d * (y - m1) / p - (1 - d) * (y - m0) / (1 - p)
    got = causal.aipw(df, "y", "d", ["a", "b"]).first()
    assert got["effect"] == pytest.approx(score.mean(), abs=1e-6)
    assert got["std_error"] == pytest.approx(score.std(ddof=1) / v["n"] ** 0.5, abs=1e-6)


def test_cox_by_newton_on_all_rows(data):
    v, df = data
    x, t, e, b = np.column_stack([v["a"], v["b"]]), v["t"], v["e"], np.zeros(2)
    for _ in range(20):
        r = np.exp(x @ b)
        g, h = np.zeros(2), np.zeros((2, 2))
        for i in np.flatnonzero(e):
            w = r * (t >= t[i])
            m = w @ x / w.sum()
            g += x[i] - m
            h += (x * w[:, None]).T @ x / w.sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    fit = models.cox(df, "t", "e", ["a", "b"])
    assert np.allclose(fit.coef, b, atol=1e-6) and np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv(h))), atol=1e-6)


def test_quantile_regression_meets_its_optimality_condition(data):
    v, df = data
    fit = models.quantile_regression(df, "y", ["a", "b"], 0.3)
    x = np.column_stack([np.ones(v["n"]), v["a"], v["b"]])
    e = v["y"] - x @ fit.coef
    on = np.abs(e) < 1e-4 * e.std()
    slack = x[~on].T @ (0.3 - (e[~on] < 0))
    assert on.sum() <= 6 and (np.abs(slack) <= np.abs(x[on]).sum(axis=0) + 1e-6).all()
    loss = lambda b: ((v["y"] - x @ b) * (0.3 - (v["y"] - x @ b < 0))).sum()
    rng = np.random.default_rng(0)
    assert all(loss(fit.coef) <= loss(fit.coef + s * rng.normal(size=3)) + 1e-6 * loss(fit.coef) for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_elastic_net_meets_its_conditions(data):
    v, df = data
    got = {}
    for r in models.elastic_net(df, "y", ["a", "b", "t"], [0.3, 0.05], 0.6).collect():
        got.setdefault(r["penalty"], {})[r["term"]] = r["estimate"]
    x = np.column_stack([v["a"], v["b"], v["t"]])
    z, s, ys = (x - x.mean(axis=0)) / x.std(axis=0), x.std(axis=0), v["y"].std()
    for penalty, coef in got.items():
        b = np.array([coef["a"], coef["b"], coef["t"]]) * s / ys
        lam = penalty / ys
        g = z.T @ ((v["y"] - v["y"].mean()) / ys - z @ b) / v["n"] - lam * 0.4 * b
        for gj, bj in zip(g, b, strict=True):
            assert (gj == pytest.approx(lam * 0.6 * np.sign(bj), abs=2e-3)) if bj else abs(gj) <= lam * 0.6 + 2e-3


def test_reset_and_sargan(data, spark):
    v, df = data
    x = np.column_stack([np.ones(v["n"]), v["a"], v["b"]])
    fitted = x @ np.linalg.lstsq(x, v["y"], rcond=None)[0]
    rss = lambda m: float(((v["y"] - m @ np.linalg.lstsq(m, v["y"], rcond=None)[0]) ** 2).sum())
    z = (fitted - fitted.mean()) / fitted.std()
    full = np.column_stack([x, z**2, z**3])
    f, k, dof, p = models.reset(df, "y", ["a", "b"])
    assert (k, dof) == (2, v["n"] - 5) and 0 <= p <= 1
    assert f == pytest.approx((rss(x) - rss(full)) / 2 / (rss(full) / dof), rel=1e-6)
    w = np.column_stack([np.ones(v["n"]), v["b"], v["t"], v["e"]])
    q = np.column_stack([np.ones(v["n"]), v["a"]])
    b = np.linalg.lstsq(w @ np.linalg.lstsq(w, q, rcond=None)[0], v["y"], rcond=None)[0]
    e = v["y"] - q @ b
    told = w @ np.linalg.lstsq(w, e, rcond=None)[0]
    stat, dof, p = models.sargan(df, "y", [], ["a"], ["b", "t", "e"])
    assert dof == 2 and 0 <= p <= 1 and stat == pytest.approx(v["n"] * (1 - ((e - told) ** 2).sum() / ((e - e.mean()) ** 2).sum()), rel=1e-6)


def test_partial_autocorrelations_and_granger(data):
    v, df = data
    y = v["y"] - v["y"].mean()
    r = np.array([y[k:] @ y[: len(y) - k] for k in range(6)]) / (y @ y)
    expected = [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1 : k + 1])[-1] for k in range(1, 6)]
    assert np.allclose(series.pacf(df, "y", ["id"], 5), expected, atol=1e-9)
    n = v["n"]
    x = np.column_stack([np.ones(n - 2), *(v[c][2 - k : n - k] for k in (1, 2) for c in ("y", "a"))])
    b = np.linalg.lstsq(x, v["y"][2:], rcond=None)[0]
    e = v["y"][2:] - x @ b
    cov = np.linalg.inv(x.T @ x) * (e @ e) / (n - 2 - 5)
    at = [2, 4]
    f = b[at] @ np.linalg.solve(cov[np.ix_(at, at)], b[at]) / 2
    got = models.granger(df, "a", "y", ["id"], 2)
    assert got[0] == pytest.approx(f, rel=1e-6) and 0 <= got[-1] <= 1


def test_components_groups_and_rules(data, spark):
    v, df = data
    z = np.column_stack([v["a"], 3 * v["b"], v["y"]])
    rows = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(z)], "id long, v array<double>")
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = learn.pca(rows, "v", 2).orderBy("component").collect()
    assert np.allclose([r["variance"] for r in got], values[:2]) and np.allclose([r["share"] for r in got], values[:2] / values.sum())
    far = spark.createDataFrame([(i, [float(c) for c in (r / 100 + 10 * (i % 3))]) for i, r in enumerate(z)], "id long, v array<double>")
    told = {r["id"]: r["cluster"] for r in learn.kmeans(far, "v", "id", 3).collect()}
    assert len({(i % 3, c) for i, c in told.items()}) == 3
    baskets = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["a"],), (["b", "c"],)], "items array<string>")
    rules = {(r["antecedent"], r["consequent"]): (r["confidence"], r["lift"], r["support"]) for r in learn.association_rules(baskets, "items", 0.25, 0.5).collect()}
    assert rules[("a", "b")] == pytest.approx((2 / 3, 8 / 9, 0.5)) and rules[("c", "b")] == pytest.approx((1.0, 4 / 3, 0.25))
    assert ("b", "c") not in rules


def test_normal_mixture_of_two_far_groups(spark):
    rng = np.random.default_rng(3)
    low, high = rng.normal(0, 1, 150), rng.normal(30, 2, 50)
    df = spark.createDataFrame([(float(v),) for v in np.concatenate([low, high])], "v double")
    got = sorted(map(tuple, cluster.normal_mixture(df, "v", 2).select("weight", "mean", "sd").collect()), key=lambda r: r[1])
    assert np.allclose(got, [(0.75, low.mean(), low.std()), (0.25, high.mean(), high.std())], atol=1e-4)


def test_exponential_smoothing_follows_a_line_and_a_season(spark):
    rows = [("a", i, 5.0 + 2 * i) for i in range(40)]
    got = models.holt_winters(spark.createDataFrame(rows, "s string, i int, v double"), "v", ["i"], ["s"], 1, 3)
    at = [c for c in got.columns if c in ("forecast", "value", "prediction")][0]
    assert [r[at] for r in got.orderBy(got.columns[1]).collect()][-3:] == pytest.approx([85.0, 87.0, 89.0], abs=0.2)
