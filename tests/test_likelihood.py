"""Likelihood models: their scores vanish and they find the values that made the data."""

import math

import numpy as np
import pytest

from statloom.operators import likelihood, moments


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x, u = rng.normal(size=n), rng.uniform(size=n)
    mu = np.exp(0.5 + 0.4 * x)
    nb = rng.poisson(rng.gamma(2.0, mu / 2.0))
    pois = rng.poisson(mu)
    zi = np.where(u < 0.3, 0, pois)
    latent = 0.8 * x + rng.logistic(size=n)
    grade = np.digitize(latent, [-1.0, 0.5])
    util = np.column_stack([np.zeros(n), 0.3 + 0.7 * x, -0.2 - 0.5 * x]) + rng.gumbel(size=(n, 3))
    life = np.exp(1.0 + 0.5 * x + 0.7 * np.log(rng.exponential(size=n)))
    stop = rng.exponential(6, size=n)
    rows = [(int(i), float(x[i]), int(nb[i]), int(pois[i]), int(zi[i]), int(grade[i]), "abc"[util[i].argmax()], float(min(life[i], stop[i])), int(life[i] <= stop[i]), float(max(0.0, 0.3 + x[i] + rng.normal())), int(u[i] < 1 / (1 + math.exp(-0.3 - x[i])))) for i in range(n)]
    return spark.createDataFrame(rows, "i int, x double, nb int, p int, zi int, grade int, pick string, life double, event int, tob double, b int").cache(), x, rows


def near(fit, want):
    for name, value in want.items():
        i = fit.names.index(name)
        assert abs(fit.coef[i] - value) < 4 * fit.se[i] + 1e-9, (name, fit.coef[i], value, fit.se[i])


def test_log_gamma(spark):
    values = [1e-3, 0.2, 1.0, 2.5, 30.0, 1e5]
    from pyspark.sql import functions as F

    got = [r.g for r in spark.createDataFrame([(v,) for v in values], "v double").select(likelihood.log_gamma(F.col("v")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-10, abs=1e-10)


def test_counts(data):
    df, *_ = data
    near(likelihood.negative_binomial(df, "nb", ["x"]), {"(Intercept)": 0.5, "x": 0.4, "ln_alpha": math.log(0.5)})
    near(likelihood.zero_inflated(df, "zi", ["x"], []), {"(Intercept)": 0.5, "x": 0.4, "zero_(Intercept)": math.log(0.3 / 0.7)})
    some, positive = likelihood.hurdle(df, "p", ["x"])
    near(positive, {"(Intercept)": 0.5, "x": 0.4})
    assert some.kind == "logit"


def test_generic_maximum_agrees_with_newton(data):
    from pyspark.sql import functions as F

    df, *_ = data
    exact = moments.glm(df, "b", ["x"], "logit")
    z = lambda t: t[0] + t[1] * F.col("x")
    fit = likelihood.maximize(df, lambda t: F.col("b") * z(t) - F.log1p(F.exp(z(t))), [0.0, 0.0], ["(Intercept)", "x"])
    assert fit.coef == pytest.approx(exact.coef, abs=1e-6) and fit.se == pytest.approx(exact.se, rel=1e-3)


def test_choices(data, spark):
    df, x, rows = data
    fit = likelihood.ordered(df, "grade", ["x"])
    near(fit, {"x": 0.8, "cut1": -1.0})
    assert fit.extra["cuts"][1] == pytest.approx(0.5, abs=0.2)
    probit = likelihood.ordered(df, "grade", ["x"], "probit")
    assert probit.coef[0] == pytest.approx(fit.coef[0] / 1.7, abs=0.08)
    m = likelihood.multinomial(df, "pick", ["x"])
    near(m, {"b:(Intercept)": 0.3, "b:x": 0.7, "c:(Intercept)": -0.2, "c:x": -0.5})
    # the same model as a conditional logit of interactions
    long = [(r[0], int(r[6] == k), *(float(k == l) * v for l in "bc" for v in (1.0, r[1]))) for r in rows for k in "abc"]
    c = likelihood.conditional(spark.createDataFrame(long, "i int, hit int, b0 double, b1 double, c0 double, c1 double"), "hit", ["b0", "b1", "c0", "c1"], "i")
    assert c.coef == pytest.approx(m.coef, abs=1e-6) and c.extra["log_likelihood"] == pytest.approx(m.extra["log_likelihood"])


def test_times_and_limits(data):
    df, *_ = data
    near(likelihood.accelerated_failure(df, "life", "event", ["x"]), {"(Intercept)": 1.0, "x": 0.5, "ln_scale": math.log(0.7)})
    e = likelihood.accelerated_failure(df, "life", "event", ["x"], "exponential")
    w = likelihood.accelerated_failure(df, "life", "event", ["x"], "loglogistic")
    assert e.extra["log_likelihood"] < w.extra["log_likelihood"]
    near(likelihood.tobit(df, "tob", ["x"]), {"(Intercept)": 0.3, "x": 1.0, "ln_sigma": 0.0})


def test_marginal_effects(data):
    df, x, _ = data
    fit = moments.glm(df, "b", ["x"], "logit")
    r = likelihood.marginal_effects(df, fit, ["x"]).first()
    p = 1 / (1 + np.exp(-(fit.coef[0] + fit.coef[1] * x)))
    assert r.effect == pytest.approx(fit.coef[1] * (p * (1 - p)).mean()) and r.std_error > 0
