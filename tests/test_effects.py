"""Treatment effects and spatial statistics on made-up data, against numpy."""

import numpy as np
import pytest

from statloom.operators import effects, spatial


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    n = 1500
    a, b = rng.normal(size=n), rng.normal(size=n)
    d = (rng.uniform(size=n) < 1 / (1 + np.exp(-0.6 * a))).astype(int)
    m = 0.5 * d + 0.3 * a + rng.normal(size=n) * 0.5
    y = 2.0 * d + a - 0.5 * b + rng.normal(size=n) * 0.5
    r = 1.5 * m + 0.7 * d + rng.normal(size=n) * 0.3
    run = rng.uniform(-1, 1, n)
    take = (rng.uniform(size=n) < 0.2 + 0.6 * (run >= 0)).astype(int)
    jump = 3.0 * take + run + rng.normal(size=n) * 0.2
    rows = [(i, *map(float, (a[i], b[i])), int(d[i]), *map(float, (m[i], y[i], r[i], run[i])), int(take[i]), float(jump[i])) for i in range(n)]
    return {"a": a, "b": b, "d": d, "y": y}, spark.createDataFrame(rows, "i int, a double, b double, d int, m double, y double, r double, run double, take int, jump double").cache()


def test_average_effects(data):
    _, df = data
    x = ["a", "b"]
    assert effects.nearest_match(df, "y", "d", x).first().effect == pytest.approx(2, abs=0.25)
    assert effects.exact_cells(df, "y", "d", x, 4).first().effect == pytest.approx(2, abs=0.3)
    assert all(abs(r.effect - 2) < 0.6 for r in effects.subclasses(df, "y", "d", x).collect())
    for out in (effects.entropy_balance(df, "y", "d", x), effects.double_ml(df, "y", "d", x, "i"), effects.tmle(df, "y", "d", x)):
        r = out.first()
        assert abs(r.effect - 2) < 5 * r.std_error and r.std_error < 0.15
    assert effects.standardized(df, "y", "d", x).first().effect == pytest.approx(2, abs=0.1)
    w = effects.entropy_weights(df, "d", x)
    assert max(abs(r.difference) for r in effects.balance(df, "d", x, w).collect()) < 1e-6
    paths = {r.path: r.effect for r in effects.mediation(df, "r", "d", "m", ["a"]).collect()}
    assert paths["indirect"] == pytest.approx(0.75, abs=0.12) and paths["direct"] == pytest.approx(0.7, abs=0.08)


def test_nearest_match_against_plain_search(data, spark):
    v, df = data
    from pyspark.sql import functions as F

    from statloom.operators.causal import _score

    rows = df.select(F.round(_score(df, "d", ["a", "b"], 1e-6), 12).alias("p"), "d", "y").collect()
    p, d, y = (np.array([r[k] for r in rows]) for k in ("p", "d", "y"))
    pc, yc = p[d == 0], y[d == 0]
    got = []
    for q, u in zip(p[d == 1], y[d == 1], strict=True):
        gap = np.abs(pc - q)
        got.append(u - yc[gap <= gap.min() + 1e-13].mean())
    assert effects.nearest_match(df, "y", "d", ["a", "b"]).first().effect == pytest.approx(np.mean(got), abs=1e-6)


def test_designs(data, spark):
    _, df = data
    h = effects.rd_bandwidth(df, "jump", "run", 0.0)
    assert 0.05 < h < 3 and effects.fuzzy_rd(df, "jump", "take", "run", 0.0, 0.6).first().effect == pytest.approx(3, abs=0.4)
    assert effects.rd_many(df, "jump", "run", [-0.4, 0.0], 0.4).count() == 2 and effects.rd_sensitivity(df, "jump", "run", 0.0, [0.3, 0.6]).count() == 2
    z = spark.createDataFrame([(z, d, y) for z in (0, 1) for d in (0, 1) for y in (0, 1) for _ in range(5 + 10 * (z == d) + 10 * (d == y))], "z int, d int, y int")
    r = effects.iv_bounds(z, "y", "d", "z").first()
    assert -1 <= r.low <= r.high <= 1
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 20)).cumsum(axis=1)
    target = base[:3].T @ [0.5, 0.3, 0.2] + 2.0 * (np.arange(20) >= 14)
    panel = spark.createDataFrame([(int(u), t, float(v)) for u, row in enumerate([*base, target]) for t, v in enumerate(row)], "u int, t int, y double")
    weights, path = effects.synthetic_control(panel, "y", "u", "t", 8, 14)
    assert sorted(((r.unit, round(r.weight, 2)) for r in weights.collect() if r.weight > 0.01)) == [(0, 0.5), (1, 0.3), (2, 0.2)]
    assert all(r.gap == pytest.approx(2 * (r.time >= 14), abs=0.02) for r in path.collect())
    assert effects.panel_unit_root(panel, "y", "u", ["t"]).first().entities == 9


def test_bacon_adds_up(spark):
    from statloom.operators import models

    rng = np.random.default_rng(3)
    rows = [(u, t, g, float(u + 0.3 * t + 2.0 * (g is not None and t >= g) + rng.normal())) for u in range(30) for t in range(8) for g in [(None, 3, 5)[u % 3]]]
    df = spark.createDataFrame(rows, "u int, t int, g int, y double")
    out = effects.bacon(df, "y", "u", "t", "g").toPandas()
    from pyspark.sql import functions as F

    fit = models.hdfe(df.withColumn("d", F.coalesce((F.col("t") >= F.col("g")).cast("int"), F.lit(0))).drop("g"), "y", ["d"], ["u", "t"])
    assert out.weight.sum() == pytest.approx(1) and (out.weight * out.estimate).sum() == pytest.approx(fit.coef[0], abs=1e-4)


def test_space(spark):
    rng = np.random.default_rng(9)
    grid = [(i, float(i % 12), float(i // 12)) for i in range(144)]
    w = np.array([[0 < (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1.5 for b in grid] for a in grid], float)
    w /= w.sum(axis=1, keepdims=True)
    x, e = rng.normal(size=144), rng.normal(size=144) * 0.3
    y = np.linalg.solve(np.eye(144) - 0.5 * w, 1 + 2 * x + e)
    se = 1 + 2 * x + np.linalg.solve(np.eye(144) - 0.5 * w, e)
    df = spark.createDataFrame([(i, px, py, float(x[i]), float(y[i]), float(se[i])) for i, px, py in grid], "i int, px double, py double, x double, y double, s double").cache()
    near = spatial.neighbours(df, "i", "px", "py", 1.0).cache()
    w1 = np.array([[0 < (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1.0 for b in grid] for a in grid], float)
    w1 /= w1.sum(axis=1, keepdims=True)
    z = y - y.mean()
    assert spatial.moran(df, near, "i", "y").first().statistic == pytest.approx(144 / w1.sum() * (z @ w1 @ z) / (z @ z))
    c = 143 * (w1 * (y[:, None] - y[None]) ** 2).sum() / (2 * w1.sum() * (z @ z))
    assert spatial.geary(df, near, "i", "y").first().statistic == pytest.approx(c)
    local = {r.i: r.statistic for r in spatial.local_moran(df, near, "i", "y").collect()}
    assert [local[i] for i in range(144)] == pytest.approx(z * (w1 @ z) / z.var())
    wide = spatial.neighbours(df, "i", "px", "py", 1.22)
    fit = spatial.spatial_lag(df, near, "i", "y", ["x"])
    assert fit.coef[fit.names.index("x")] == pytest.approx(2, abs=0.25)
    assert {r.test: r.p_value for r in spatial.lag_tests(df, near, "i", "y", ["x"]).collect()}["lag"] < 0.05
    assert spatial.spatial_error(df, near, "i", "s", ["x"]).coef[1] == pytest.approx(2, abs=0.2)
    assert wide.count() == near.count()
