"""Models of series on simulated ones, against plain recursions."""

import numpy as np
import pytest

from statloom.operators import forecast


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    n = 400
    ar = forecast.simulate_arma(n, [0.6], [], seed=3)
    step = np.concatenate([rng.normal(size=150), rng.normal(size=250) + 4])
    season = 10 + 0.05 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(size=n) * 0.2
    walk = np.cumsum(rng.normal(size=n))
    rows = [(k, i, float(v)) for k, x in (("ar", ar), ("step", step), ("season", season), ("walk", walk)) for i, v in enumerate(x)]
    return {"ar": ar, "step": step, "season": season, "walk": walk}, spark.createDataFrame(rows, "k string, i int, v double").cache()


def test_autoregressions(series):
    x, df = series
    got = {(r.k, r.lag): r.coefficient for r in forecast.ar(df, "v", ["i"], ["k"], 1).collect()}
    c = forecast.autocovariance(x["ar"], 1)
    assert got["ar", 1] == pytest.approx(c[1] / c[0])
    f = {(r.k, r.step): r for r in forecast.arima(df.where("k = 'ar'"), "v", ["i"], ["k"], (1, 0, 0), 5).collect()}
    phi, _, mean, v, *_ = forecast.fit_arima(x["ar"], 1, 0, 0)
    assert phi[0] == pytest.approx(0.6, abs=0.12) and f["ar", 1].forecast == pytest.approx(mean + phi[0] * (x["ar"][-1] - mean))
    phi, theta, *_ = forecast.fit_arima(forecast.simulate_arma(1500, [0.5], [0.4], seed=1), 1, 0, 1)
    assert (phi[0], theta[0]) == pytest.approx((0.5, 0.4), abs=0.12)
    w = forecast.arima(df.where("k = 'walk'"), "v", ["i"], ["k"], (0, 1, 0), 3).orderBy("step").collect()
    assert all(r.forecast == pytest.approx(x["walk"][-1]) for r in w) and w[2].high - w[2].low > w[0].high - w[0].low
    assert forecast.arma_acf([0.6], [], 3) == pytest.approx([1, 0.6, 0.36, 0.216]) and forecast.arma_to_ma([0.5], [0.4], 3) == pytest.approx([0.9, 0.45, 0.225])


def test_parts_and_changes(series):
    x, df = series
    rows = forecast.stl(df.where("k = 'season'"), "v", ["i"], ["k"], 12).toPandas().sort_values("place")
    assert np.abs(rows.trend + rows.seasonal + rows.remainder - x["season"]).max() < 1e-9
    assert np.abs(rows.seasonal - 3 * np.sin(2 * np.pi * np.arange(400) / 12)).mean() < 0.35
    got = [r.place for r in forecast.changes(df.where("k = 'step'"), "v", ["i"], ["k"]).collect()]
    assert got == [150] and forecast.binary_segmentation(x["step"]) == [150]
    short = x["step"][140:165]
    cost = lambda a: ((a - a.mean()) ** 2).sum()
    best = min(range(2, 24), key=lambda k: cost(short[:k]) + cost(short[k:]))
    assert forecast.change_points(short, 5.0) == [best]


def test_states_and_spectra(series):
    x, df = series
    y = x["walk"][:30]
    k = forecast.kalman(y, np.eye(1), np.ones(1), np.eye(1), 0.5, np.zeros(1), 1e6 * np.eye(1), True)
    a = np.linalg.inv(np.diag(np.full(30, 2.0)) + sum(np.outer(d, d) for d in (np.eye(30)[i + 1] - np.eye(30)[i] for i in range(29))) + 1e-6 * np.outer(np.eye(30)[0], np.eye(30)[0])) @ (2 * y)
    assert k["smoothed"][:, 0] == pytest.approx(a, abs=1e-4)
    assert forecast.structural(df.where("k = 'walk'"), "v", ["i"], ["k"]).count() == 400
    p = forecast.spectrum(df.where("k = 'season'"), "v", ["i"], ["k"]).orderBy("density", ascending=False).first()
    assert p.frequency == pytest.approx(1 / 12, abs=0.004)
    tests = {r.k: r.p_value for r in forecast.white_noise(df, "v", ["i"], ["k"]).collect()}
    assert tests["walk"] < 1e-6
    pp = {r.k: r.z_tau for r in forecast.phillips_perron(df, "v", ["i"], ["k"]).collect()}
    assert pp["ar"] < -5 < pp["walk"]
    g = forecast.garch(df.where("k = 'ar'"), "v", ["i"], ["k"], 2).first()
    assert 0 <= g.alpha < 1 and g.variance > 0
    irf = forecast.impulse_responses([np.array([[0.5, 0.0], [0.2, 0.3]])], np.eye(2), 2)
    assert irf[2] == pytest.approx(np.array([[0.5, 0.0], [0.2, 0.3]]) @ np.array([[0.5, 0.0], [0.2, 0.3]]))
    assert forecast.embedded(df, "v", ["i"], 3, ["k"]).count() == 4 * 398
    flt = {r.place: r.filtered for r in forecast.linear_filter(df.where("k = 'ar'"), "v", ["i"], ["k"], [0.25, 0.5, 0.25]).collect()}
    assert flt[5] == pytest.approx(x["ar"][4:7] @ [0.25, 0.5, 0.25]) and flt[0] is None


def test_impact_and_cointegration(spark):
    rng = np.random.default_rng(4)
    c = np.cumsum(rng.normal(size=200))
    y = 2 + 0.8 * c + rng.normal(size=200) * 0.3 + 1.5 * (np.arange(200) >= 150)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(c, y, strict=True))], "i int, c double, y double")
    r = forecast.causal_impact(df, "y", ["c"], ["i"], 150).first()
    assert r.average == pytest.approx(1.5, abs=0.3) and r.low > 0 and r.p_value < 0.01
    j = forecast.cointegration(df.where("i < 150"), ["c", "y"], ["i"]).orderBy("rank").collect()
    assert j[0].trace > 15.4 and j[1].eigenvalue < j[0].eigenvalue
