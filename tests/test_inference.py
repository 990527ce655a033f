"""More tests and descriptions against numpy and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import inference


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.3], [0, 0, 1]])
    g = np.repeat(["a", "b", "c"], 80)
    x[:, 0] += np.repeat([0, 0.4, 1.0], 80)
    w = rng.uniform(0.5, 2, 240)
    rows = [(str(g[i]), *map(float, x[i]), float(w[i]), i % 8, int(x[i, 0] > 0.3), int(x[i, 1] > 0)) for i in range(240)]
    return x, g, w, spark.createDataFrame(rows, "g string, a double, b double, c double, w double, k int, p int, q int").cache()


def test_quantiles_and_numbers(data, spark):
    x, _, w, df = data
    got = {round(r.probability, 3): r.value for r in inference.quantiles(df, "a", [0, 0.1, 0.5, 0.93, 1]).collect()}
    assert got == pytest.approx({p: float(np.quantile(x[:, 0], p)) for p in (0, 0.1, 0.5, 0.93, 1)})
    for kind, name in ((1, "inverted_cdf"), (2, "averaged_inverted_cdf"), (4, "interpolated_inverted_cdf"), (5, "hazen"), (6, "weibull"), (8, "median_unbiased"), (9, "normal_unbiased")):
        got = [r.value for r in inference.quantiles(df, "a", [0.05, 0.3, 0.77], kind).orderBy("probability").collect()]
        assert got == pytest.approx(np.quantile(x[:, 0], [0.05, 0.3, 0.77], method=name).tolist())
    assert tuple(inference.fivenum(spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double"), "v").first()) == (1, 3, 5.5, 8, 10)
    assert inference.weighted_mean(df, "a", "w").first()["mean"] == pytest.approx(np.average(x[:, 0], weights=w))
    cov = {(r.a, r.b): r.value for r in inference.weighted_covariance(df, ["a", "b"], "w").collect()}
    want = np.cov(x[:, :2].T, aweights=w)
    assert cov["a", "b"] == pytest.approx(want[0, 1]) and cov["b", "b"] == pytest.approx(want[1, 1])
    z = x - x.mean(axis=0)
    far = np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(x.T)), z)
    assert sorted(r.distance for r in inference.mahalanobis(df, ["a", "b", "c"]).collect()) == pytest.approx(sorted(far))


def test_exact_tests():
    r = inference.binomial_test(682, 925, 0.75)
    assert r["p_value"] == pytest.approx(0.3824916, abs=1e-6) and (r["low"], r["high"]) == pytest.approx((0.7076683, 0.7654066), abs=1e-6)
    for k, n, p in ((0, 5, 0.2), (5, 5, 0.5), (3, 9, 0.35)):
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert inference.binomial_test(k, n, p)["p_value"] == pytest.approx(min(1, sum(v for v in pmf if v <= pmf[k] * (1 + 1e-7))))
    r = inference.poisson_test(137, 24.19893)
    assert r["estimate"] == pytest.approx(5.661407, abs=1e-6) and (r["low"], r["high"]) == pytest.approx((4.753125, 6.692709), abs=1e-4)
    assert inference.poisson_test(3, 1, 5)["p_value"] == pytest.approx(sum(math.exp(-5) * 5**k / math.factorial(k) for k in [0, 1, 2, 3, 7, 8, 9, *range(10, 60)]), abs=1e-6)


def test_studentized_range():
    assert inference.studentized_range_upper(3.633, 3, 15) == pytest.approx(0.0535, abs=0.002)
    assert inference.studentized_range_upper(3.674, 3, 15) == pytest.approx(0.05, abs=5e-4)
    assert inference.studentized_range_upper(4.020, 4, 17) == pytest.approx(0.05, abs=5e-4)
    t = 2.3
    assert inference.studentized_range_upper(t * math.sqrt(2), 2, 10) == pytest.approx(2 * (1 - 0.97788), abs=2e-3)


def test_groups(data):
    x, g, _, df = data
    parts = [x[g == k, 0] for k in "abc"]
    mse = sum(((p - p.mean()) ** 2).sum() for p in parts) / 237
    got = {(r.a, r.b): r for r in inference.pairwise_t(df, "a", "g", "none").collect()}
    assert got["c", "a"].statistic == pytest.approx((parts[2].mean() - parts[0].mean()) / math.sqrt(mse * 2 / 80))
    hsd = {(r.a, r.b): r for r in inference.tukey_hsd(df, "a", "g").collect()}
    r = hsd["c", "a"]
    assert r.difference == pytest.approx(parts[2].mean() - parts[0].mean()) and r.low < r.difference < r.high and 0 <= r.p_value <= got["c", "a"].p_value * 3
    c = inference.contrast(df, "a", "g", {"a": -0.5, "b": -0.5, "c": 1.0}).first()
    assert c.estimate == pytest.approx(parts[2].mean() - (parts[0].mean() + parts[1].mean()) / 2) and c.std_error == pytest.approx(math.sqrt(mse * 1.5 / 80))
    assert {r.a + r.b for r in inference.pairwise_wilcoxon(df, "a", "g").collect()} == {"ba", "ca", "cb"}


def test_scale_tests(data):
    from statloom.functions import special

    x, g, _, df = data
    z = np.concatenate([x[g == k, 0] - np.median(x[g == k, 0]) for k in "abc"])
    rank = np.abs(z).argsort().argsort() + 1.0
    a = np.array([special.normal_quantile((1 + r / 241) / 2) for r in rank])
    parts = np.split(a, 3)
    want = sum(80 * (p.mean() - a.mean()) ** 2 for p in parts) / a.var(ddof=1)
    assert inference.fligner(df, "a", "g").first().statistic == pytest.approx(want, rel=1e-6)
    two = np.concatenate([x[g == "a", 0], x[g == "b", 0]])
    r = two.argsort().argsort()[:80] + 1.0
    assert inference.mood(df, "a", "g", "a", "b").first().statistic == pytest.approx(((r - 80.5) ** 2).sum())
    assert inference.ansari(df, "a", "g", "a", "b").first().statistic == pytest.approx(np.minimum(r, 161 - r).sum())


def test_tables(data):
    x, g, _, df = data
    d = v = top = low = 0.0
    p, q, k = (x[:, 0] > 0.3).astype(int), (x[:, 1] > 0).astype(int), np.arange(240) % 8
    for s in range(8):
        n11, n10, n01, n00 = (float(((p == i) & (q == j) & (k == s)).sum()) for i in (1, 0) for j in (1, 0))
        n = n11 + n10 + n01 + n00
        d += n11 - (n11 + n10) * (n11 + n01) / n
        v += (n11 + n10) * (n11 + n01) * (n10 + n00) * (n01 + n00) / (n * n * (n - 1))
        top, low = top + n11 * n00 / n, low + n10 * n01 / n
    r = inference.mantel_haenszel(df, "p", "q", "k").first()
    assert r.statistic == pytest.approx((abs(d) - 0.5) ** 2 / v) and r.odds_ratio == pytest.approx(top / low) and r.low < r.odds_ratio < r.high
    m = inference.loglinear(df, ["p", "q"], [["p"], ["q"]]).first()
    seen = np.array([[((p == i) & (q == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    fit = np.outer(seen.sum(1), seen.sum(0)) / 240
    assert m.pearson == pytest.approx(((seen - fit) ** 2 / fit).sum()) and m.df == 1 and m.likelihood_ratio == pytest.approx(2 * (seen * np.log(seen / fit)).sum())
    trend = inference.proportion_test(df, F.col("p") == 1, "g").first()
    share = np.array([(p[g == c]).mean() for c in "abc"])
    assert trend.statistic == pytest.approx(80 * ((share - p.mean()) ** 2).sum() / (p.mean() * (1 - p.mean())))
    effects = {(r.term, r.level): r.effect for r in inference.cell_means(df, "a", ["g", "p"]).collect()}
    assert effects["g", "b"] == pytest.approx(x[g == "b", 0].mean() - x[:, 0].mean())


def test_matrices(data):
    x, g, _, df = data
    w = sum((x[g == k] - x[g == k].mean(0)).T @ (x[g == k] - x[g == k].mean(0)) for k in "abc")
    t = (x - x.mean(0)).T @ (x - x.mean(0))
    got = {r.test: r for r in inference.manova(df, ["a", "b", "c"], "g").collect()}
    assert got["wilks"].value == pytest.approx(np.linalg.det(w) / np.linalg.det(t)) and got["pillai"].value == pytest.approx(np.trace((t - w) @ np.linalg.inv(t)))
    r = inference.canonical_correlations(df, ["a"], ["b", "c"]).first()
    design = np.column_stack([np.ones(240), x[:, 1:]])
    e = x[:, 0] - design @ np.linalg.lstsq(design, x[:, 0], rcond=None)[0]
    assert r.correlation**2 == pytest.approx(1 - e @ e / t[0, 0])
    load = inference.factor_analysis(df, ["a", "b", "c"], 1).collect()
    lam = np.array([r.loading for r in load])
    assert np.outer(lam, lam)[np.triu_indices(3, 1)] == pytest.approx(np.corrcoef(x.T)[np.triu_indices(3, 1)], abs=2e-3)
    assert 0 < inference.mauchly(df, ["a", "b", "c"]).first().w <= 1


def test_samples_and_curves(data, spark):
    x, _, _, df = data
    assert inference.shapiro_wilk(spark.createDataFrame([(float(v),) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)], "v double"), "v").first().statistic == pytest.approx(0.79, abs=0.005)
    assert 0.0 < inference.shapiro_wilk(df, "b").first().p_value <= 1
    s = np.sort(x[:, 1])
    from statloom.functions import special

    cdf = np.array([special.normal_cdf(v) for v in s])
    want = max((np.arange(1, 241) / 240 - cdf).max(), (cdf - np.arange(240) / 240).max())
    assert inference.ks_one(df, "b").first().statistic == pytest.approx(want, abs=1e-6)
    d = inference.density(df, "b", 256).toPandas()
    assert (d.density * (d.x[1] - d.x[0])).sum() == pytest.approx(1, abs=0.01)
    fit = inference.isotonic(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "x double, y double"), "x", "y").orderBy("x").collect()
    assert [r.fitted for r in fit] == pytest.approx([1, 2.5, 2.5, 4])
    t = np.linspace(0, 3, 9)
    assert inference.interpolate(t, np.sin(t), t, "spline") == pytest.approx(np.sin(t).tolist())
    assert inference.interpolate([0, 1, 2], [0, 1, 4], [0.5, 1.5]) == pytest.approx([0.5, 2.5])
    polish = {(r.term, r.level): r.effect for r in inference.median_polish(spark.createDataFrame([(i, j, 10.0 + i + 3 * j) for i in range(3) for j in range(3)], "i int, j int, v double"), "v", "i", "j").collect()}
    assert polish["overall", ""] == 14 and polish["row", "2"] == 1 and polish["column", "0"] == -3


def test_shapiro_wilk_of_many_rows(spark):
    # more rows than are brought to the driver, tied ones among them: W by its definition in numpy, as for fewer rows
    from statistics import NormalDist

    rng = np.random.default_rng(3)
    n = 3 * inference.MAX_SAMPLE
    x = np.sort(np.round(rng.gamma(30.0, 1.0, n), 2))
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    an, an1, phi = inference._outer_weights(n, float(m @ m), m[-1], m[-2])
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    r = inference.shapiro_wilk(spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "v double"), "v").first()
    assert r.n == n and r.p_value is None and r.statistic == pytest.approx((a @ x) ** 2 / ((x - x.mean()) ** 2).sum(), rel=1e-10)
    normal = spark.createDataFrame([(float(v),) for v in rng.permutation(m)], "v double")
    assert 0.9999 < inference.shapiro_wilk(normal, "v").first().statistic <= 1
    # the two ways agree where both can go
    some = normal.limit(2000)
    w, n = inference._shapiro_many(some.selectExpr("v as x"))
    assert n == 2000 and w == pytest.approx(inference.shapiro_wilk(some, "v").first().statistic, rel=1e-10)


def test_power():
    assert inference.power_proportions(50, 0.5, 0.75) == pytest.approx(0.740, abs=0.002)
    assert inference.power_anova(4, 5, 1, 3) == pytest.approx(0.3535594, abs=1e-4)
    assert inference.sample_size(lambda n: inference.power_proportions(n, 0.5, 0.75), 0.9) == pytest.approx(76.7, abs=0.2)
    assert np.allclose(inference.contrast_matrix(4, "helmert").sum(axis=0), 0) and np.allclose(inference.contrast_matrix(3, "polynomial")[:, 0], [-math.sqrt(0.5), 0, math.sqrt(0.5)])


def test_quade(spark):
    # published example of seven stores and five brands
    table = [(5, 4, 7, 10, 12), (1, 3, 1, 0, 2), (16, 12, 22, 22, 35), (5, 4, 3, 5, 4), (10, 9, 7, 13, 10), (19, 18, 28, 37, 58), (10, 7, 6, 8, 7)]
    rows = [(b, t, float(v)) for b, line in enumerate(table) for t, v in enumerate(line)]
    r = inference.quade(spark.createDataFrame(rows, "b int, t int, v double"), "v", "t", "b").first()
    assert r.statistic == pytest.approx(3.8293, abs=1e-4) and (r.df1, r.df2) == (4, 24) and r.p_value == pytest.approx(0.01519, abs=1e-4)
