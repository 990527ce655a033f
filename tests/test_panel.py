"""Dynamic panels against dense matrices."""

import numpy as np
import pytest

from statloom.operators import panel


def test_arellano_bond(spark):
    rng = np.random.default_rng(6)
    n, t = 200, 6
    y, x = np.zeros((n, t)), rng.normal(size=(n, t))
    effect = rng.normal(size=n)
    y[:, 0] = effect + rng.normal(size=n)
    for k in range(1, t):
        y[:, k] = 0.5 * y[:, k - 1] + x[:, k] + effect + rng.normal(size=n)
    rows = [(f"e{i}", 2000 + k, float(y[i, k]), float(x[i, k])) for i in range(n) for k in range(t)]
    df = spark.createDataFrame(rows, "e string, p int, y double, x double")
    z, r, d, h = [], [], [], 2 * np.eye(t - 2) - np.eye(t - 2, k=1) - np.eye(t - 2, k=-1)
    for i in range(n):
        zi, at = np.zeros((t - 2, (t - 1) * (t - 2) // 2 + 1)), 0
        for k in range(2, t):
            zi[k - 2, at : at + k - 1] = y[i, : k - 1]
            at += k - 1
            zi[k - 2, -1] = x[i, k] - x[i, k - 1]
        z.append(zi)
        r.append(np.column_stack([np.diff(y[i])[:-1], np.diff(x[i])[1:]]))
        d.append(np.diff(y[i])[1:])
    zx, zy = sum(a.T @ b for a, b in zip(z, r)), sum(a.T @ b for a, b in zip(z, d))
    w = np.linalg.inv(sum(a.T @ h @ a for a in z))
    bread = np.linalg.inv(zx.T @ w @ zx)
    one = bread @ zx.T @ w @ zy
    meat = sum(np.outer(a.T @ (c - b @ one), a.T @ (c - b @ one)) for a, b, c in zip(z, r, d))
    got, tests = panel.arellano_bond(df, "y", ["x"], "e", "p")
    got = {q["term"]: q for q in got.collect()}
    assert [got["y_l1"]["estimate"], got["x"]["estimate"]] == pytest.approx(list(one), rel=1e-8)
    assert [got["y_l1"]["std_error"], got["x"]["std_error"]] == pytest.approx(list(np.sqrt(np.diag(bread @ zx.T @ w @ meat @ w @ zx @ bread))), rel=1e-8)
    assert tests["n"] == n * (t - 2) and tests["j_df"] == 11 - 2 and tests["m1"] < -3 and abs(tests["m2"]) < 3
    w2 = np.linalg.inv(meat)
    two = np.linalg.solve(zx.T @ w2 @ zx, zx.T @ w2 @ zy)
    got, tests = panel.arellano_bond(df, "y", ["x"], "e", "p", steps=2)
    assert [q["estimate"] for q in got.collect()] == pytest.approx(list(two), rel=1e-8)
    assert tests["j"] == pytest.approx(float((zy - zx @ two) @ w2 @ (zy - zx @ two)), rel=1e-8) and abs(two[0] - 0.5) < 0.15
    gap = df.where("not (e = 'e0' and p = 2003)")
    assert panel.arellano_bond(gap, "y", ["x"], "e", "p")[1]["n"] == n * (t - 2) - 3
    with pytest.raises(Exception, match="repeats"):
        panel.arellano_bond(df.union(df.limit(1)), "y", ["x"], "e", "p")
