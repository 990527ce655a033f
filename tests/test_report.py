"""Tables, charts and small matrices."""

from xml.etree import ElementTree

import numpy as np
import pytest

from statloom.functions import matrices
from statloom.plans import charts, report


@pytest.fixture(scope="module")
def fits(spark):
    schema = "term string, estimate double, std_error double, p_value double"
    return {
        "one": spark.createDataFrame([("x_1", 1.23456, 0.1, 0.0001), ("z&", -0.5, None, None)], schema),
        "two": spark.createDataFrame([("x_1", 2.0, 0.5, 0.03)], schema),
    }


def test_model_tables(fits, spark):
    cells = report.grid(fits, 2, {"n": {"one": 10, "two": 20}})
    assert cells == [["", "one", "two"], ["x_1", "1.23***", "2.00*"], ["", "(0.10)", "(0.50)"], ["z&", "-0.50", ""], ["", "", ""], ["n", "10", "20"]]
    assert report.markdown(cells).splitlines()[:3] == ["|  | one | two |", "| --- | ---: | ---: |", "| x_1 | 1.23*** | 2.00* |"]
    tex = report.latex(cells, "A_b", "tab:a")
    assert r"x\_1 & 1.23*** & 2.00* \\" in tex and r"z\& & -0.50 &  \\" in tex and r"\caption{A\_b}" in tex
    tree = ElementTree.fromstring(report.html(cells, "<t>"))
    assert tree.find("caption").text == "<t>" and len(tree.findall("tbody/tr")) == 5
    assert report.csv_text([["a", 'b"c'], ["1", ""]]) == 'a,"b""c"\n1,\n'
    assert report.of_frame(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")) == [["a", "b", "c"], ["1", "", "0.5"]]
    assert "<h2>Fit</h2><table>" in report.page("T", [("Fit", report.html(cells))])
    with pytest.raises(ValueError):
        report.of_frame(spark.range(5), max_rows=4)


def test_charts_are_drawings_of_reduced_rows(fits, spark):
    rows = [(float(i), float(i % 7), "g" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 1.0, "g")], "x double, y double, g string")
    found, across, up = charts.cells(df, "x", "y", 10)
    assert sum(n for _, _, n in found) == 300 and across == (0.0, 299.0) and up == (0.0, 6.0)
    brute = {}
    for x, y, _ in rows:
        cell = (min(9, int(x / 29.9)), min(9, int(y / 0.6)))
        brute[cell] = brute.get(cell, 0) + 1
    assert {(i, j): n for i, j, n in found} == brute
    pictures = [
        charts.scatter(df, "x", "y"), charts.histogram(df, "x"), charts.line(df, "x", ["y"]), charts.box(df, "y", "g"), charts.coefficients(fits["one"]),
        charts.path(spark.createDataFrame([(-1, 0.0, 0.1), (0, 1.0, 0.2)], "p int, v double, e double"), "p", "v", "e", mark=-0.5),
        charts.heatmap(["a", "b"], [[1, -0.5], [-0.5, 1]], "r & s"), *charts.residuals(df, "x", "y"),
    ]
    assert all(ElementTree.fromstring(p).tag.endswith("svg") for p in pictures)
    assert charts.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x").count("3 rows") == 1
    with pytest.raises(ValueError):
        charts.histogram(df.where("x > 1000"), "x")


def test_small_matrices():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4, 4))
    s = a @ a.T + np.eye(4)
    assert np.allclose(matrices.inverse(a) @ a, np.eye(4)) and np.allclose(matrices.cholesky_inverse(s) @ s, np.eye(4))
    assert np.allclose(matrices.solve(a, a @ [1, 2, 3, 4]), [1, 2, 3, 4])
    low = matrices.cholesky(s)
    assert np.allclose(low @ low.T, s) and np.allclose(low, np.tril(low))
    values, vectors = matrices.eigen_symmetric(s)
    assert (np.diff(values) <= 0).all() and np.allclose(vectors * values @ vectors.T, s)
    poor = np.ones((2, 2))
    assert matrices.condition_number(np.diag([4.0, 2.0])) == pytest.approx(2) and matrices.condition_number(poor) > 1e12
    got, pseudo = matrices.safe_inverse(poor)
    assert pseudo and np.allclose(got, poor / 4) and not matrices.safe_inverse(s)[1]
    for wrong in (lambda: matrices.inverse(poor), lambda: matrices.inverse(np.ones((2, 3))), lambda: matrices.cholesky(-s), lambda: matrices.toeplitz_vector(a)):
        with pytest.raises(ValueError):
            wrong()
    assert matrices.toeplitz([1, 2, 3]).tolist() == [[1, 2, 3], [2, 1, 2], [3, 2, 1]]
    skew = matrices.toeplitz([1, 2, 3], [1, 8, 9])
    assert skew.tolist() == [[1, 8, 9], [2, 1, 8], [3, 2, 1]] and matrices.toeplitz_vector(skew).tolist() == [1, 2, 3, 8, 9]
    assert matrices.toeplitz_autocorrelation([0.5]).tolist() == [[1, 0.5], [0.5, 1]]
