"""One-sided tests and confidence limits: limits are the values that a test at that level just rejects."""

import numpy as np
import pytest

from statloom.functions import special
from statloom.operators import stats


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], float(v) + (i % 2) * 0.6, float(w)) for i, (v, w) in enumerate(rng.normal(size=(41, 2)))]
    return spark.createDataFrame([*rows, ("a", None, 1.0), ("b", float("nan"), 1.0)], "g string, x double, w double").cache()


def test_t_tests_reject_their_own_limits(df):
    ways = [
        lambda **k: stats.t_test_one(df, "x", **k),
        lambda **k: stats.t_test_paired(df, "x", "w", **k),
        lambda **k: stats.t_test_two(df, "x", "g", "a", "b", **k),
        lambda **k: stats.t_test_two(df, "x", "g", "a", "b", True, **k),
    ]
    for way in ways:
        both = way(level=0.9).first()
        assert way(mu=both["low"]).first()["p_value"] == pytest.approx(0.1, abs=1e-9) and way(mu=both["high"]).first()["p_value"] == pytest.approx(0.1, abs=1e-9)
        greater, less = way(alternative="greater", level=0.95).first(), way(alternative="less", level=0.95).first()
        assert greater["low"] == pytest.approx(both["low"]) and greater["high"] == float("inf") and less["high"] == pytest.approx(both["high"]) and less["low"] == float("-inf")
        assert greater["p_value"] + less["p_value"] == pytest.approx(1) and 2 * min(greater["p_value"], less["p_value"]) == pytest.approx(both["p_value"])
        assert way(alternative="greater", mu=greater["low"]).first()["p_value"] == pytest.approx(0.05, abs=1e-9)
        assert "low" not in way().columns
        with pytest.raises(ValueError):
            way(alternative="more")


def test_sides_of_variances_and_ranks(df):
    f = {k: stats.variance_test(df, "x", "g", "a", "b", 2.0, k).first() for k in stats.ALTERNATIVES}
    assert f["greater"]["p_value"] + f["less"]["p_value"] == pytest.approx(1)
    assert f["greater"]["statistic"] == pytest.approx(stats.variance_test(df, "x", "g", "a", "b").first()["statistic"] / 2)
    assert special.f_upper(special.f_critical(0.05, 3, 17), 3, 17) == pytest.approx(0.05)
    for way in (lambda k: stats.mann_whitney(df, "x", "g", "a", "b", False, k), lambda k: stats.signed_rank(df, "x", "w", 0.1, False, k)):
        p = {k: way(k).first()["p_value"] for k in stats.ALTERNATIVES}
        assert p["greater"] + p["less"] == pytest.approx(1) and 2 * min(p["greater"], p["less"]) == pytest.approx(p["two-sided"])
    rows = [r["x"] - r["w"] - 0.1 for r in df.collect() if r["x"] is not None and r["x"] == r["x"]]
    order = np.argsort(np.argsort(np.abs(rows))) + 1
    assert stats.signed_rank(df, "x", "w", 0.1).first()["statistic"] == order[np.array(rows) > 0].sum()
    assert stats.mann_whitney(df, "x", "g", "a", "b", True, "greater").first()["z"] < stats.mann_whitney(df, "x", "g", "a", "b", False, "greater").first()["z"]
