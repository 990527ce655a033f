"""Operators on small frames: null, NaN, tie and order rules, and statistics against numpy or known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.operators import aggregate, causal, clean, features, moments, ranks, reshape, series, stats, survival, transform
from statloom.operators import join as joins
from statloom.plans import sql
from statloom.sources import readers


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 30.0, True), (2, None, None, False), (3, "Bob", float("nan"), None), (4, "ann ", 25.0, True), (5, "Çelik", 30.0, False)], "id long, name string, score double, active boolean")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters_drop_nulls_and_parse_values(people):
    assert ids(transform.filter_rows(people, "score", "ge", "30")) == [1, 3, 5]  # NaN is the largest double
    assert ids(transform.filter_rows(people, "name", "starts", "A")) == [1]
    assert ids(transform.filter_rows(people, "active", "eq", "true")) == [1, 4]
    with pytest.raises(TypeError):
        transform.filter_rows(people, "id", "contains", "1")
    with pytest.raises(ValueError):
        transform.filter_rows(people, "nope", "eq", "1")


def test_division_and_logarithms_follow_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r.q for r in transform.mutate(df, "q", transform.arithmetic(F.col("a"), "/", F.col("b"))).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [1.5, None]
    logs = [r.q for r in transform.mutate(df, "q", transform.function("ln", F.col("a"))).collect()]
    assert logs[0] == 0 and math.isnan(logs[1]) and logs[2] == -math.inf


def test_missing_values(people):
    assert ids(clean.drop_na(people, ["score"])) == [1, 3, 4, 5]
    filled = clean.fill_na(people, "forward", ["name"], order_by=["id"]).orderBy("id").collect()
    assert [r.name for r in filled] == ["Ann", "Ann", "Bob", "ann ", "Çelik"]
    assert ids(clean.deduplicate(people, ["score"], "none")) == [2, 3, 4]
    assert ids(clean.deduplicate(people, ["score"], "last", ["id"])) == [2, 3, 4, 5]


def test_backward_fill_keeps_running_frames(spark):
    # a frame that ends with the last row of a partition is worked out anew for each row
    rows = [(i, i % 3, float(i) if i % 5 == 0 and i < 380 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g int, v double").repartition(5)
    for group in (None, ["g"]):
        filled = clean.fill_na(df, "backward", ["v"], order_by=["i"], group_by=group)
        assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
        want = [next((v for j, h, v in rows[i:] if v is not None and (group is None or h == g)), None) for i, g, _ in rows]
        assert [r.v for r in filled.orderBy("i").collect()] == want


def test_strings(people):
    assert clean.trim(people).where("id = 4").first().name == "ann"
    assert clean.str_pad(people, "name", 4, "*").where("id = 5").first().name == "Çelik"
    assert clean.str_substring(people, "name", -3, 2).where("id = 5").first().name == "li"
    assert clean.regex_extract(people, "name", "(n+)", "x", 1).where("id = 3").first().x is None


def test_ordered_operators_match_plain_python(spark):
    values = [float((i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame([(i, v if i % 7 else None) for i, v in enumerate(values)], "i long, v double").repartition(5)
    total, want = 0.0, []
    for i, v in enumerate(values):
        total += v if i % 7 else 0
        want.append(total if i % 7 else None)
    assert [r.v_cumsum for r in features.cumsum(df, "v", ["i"]).orderBy("i").collect()] == want
    lead = [r.v_lead3 for r in features.lead(df, "v", ["i"], 3).orderBy("i").collect()]
    assert lead == [(values[i + 3] if (i + 3) % 7 else None) if i + 3 < 500 else None for i in range(500)]
    known = sorted({v for i, v in enumerate(values) if i % 7})
    dense = {r.i: r.v_rank for r in ranks.rank(df, "v").collect()}
    assert all(dense[i] == (known.index(v) + 1 if i % 7 else None) for i, v in enumerate(values))


def test_joins_and_shapes(spark, people):
    other = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, name string")
    out = joins.full_join(people.select("id", "name"), other, ["id"])
    assert out.columns == ["id", "name", "id_right", "name_right"] and out.count() == 7
    assert ids(joins.anti_join(people, other, ["id"])) == [2, 3, 4, 5]
    long = reshape.melt(people, ["id"], ["score"])
    assert math.isnan(long.where("id = 2").first().value)
    with pytest.raises(Exception, match="more than one"):
        reshape.pivot(spark.createDataFrame([(1, "a", 2), (1, "a", 3)], "k int, o string, v int"), ["k"], "o", "v").collect()
    assert reshape.explode(spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<int>"), "a").count() == 4
    n = aggregate.group_by(people, ["active"], [("name", "nunique")]).collect()
    assert {r.active: r.name_nunique for r in n} == {True: 2, False: 2, None: 1}


def test_distributions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert special.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.f_upper(4.0, 2, 20) == pytest.approx(0.0345716, abs=1e-6)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.t_critical(5) == pytest.approx(2.570581836, abs=1e-8)
    assert special.adjust_p([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])
    assert special.adjust_p([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, z, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 20, n)
    y = 2 + 1.5 * x - 0.5 * z + 0.3 * g + rng.normal(size=n)
    b = (rng.random(n) < 1 / (1 + np.exp(-(0.2 + x)))).astype(int)
    rows = [(int(i), float(y[i]), float(x[i]), float(z[i]), int(g[i]), int(b[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i long, y double, x double, z double, g int, b int")


def test_regressions_match_numpy(sample):
    rows, df = sample
    a = np.array([[r[1], 1.0, r[2], r[3]] for r in rows])
    y, x = a[:, 0], a[:, 1:]
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    fit = moments.ols(df, "y", ["x", "z"])
    assert np.allclose(fit.coef, beta) and np.allclose(fit.vcov, inv * (e @ e) / 397)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    for kind, w in (("HC0", e**2), ("HC1", e**2 * 400 / 397), ("HC2", e**2 / (1 - h)), ("HC3", (e / (1 - h)) ** 2)):
        assert np.allclose(moments.ols(df, "y", ["x", "z"], kind).vcov, inv @ (x.T * w) @ x @ inv)
    g = np.array([r[4] for r in rows])
    u = np.array([x[g == k].T @ e[g == k] for k in range(20)])
    assert np.allclose(moments.ols(df, "y", ["x", "z"], cluster="g").vcov, inv @ (u.T @ u) @ inv * 20 / 19 * 399 / 397)
    d = np.column_stack([x[:, 1:], *(g == k for k in range(20))]).astype(float)
    assert np.allclose(moments.fixed_effects(df, "y", ["x", "z"], "g").coef, np.linalg.lstsq(d, y, rcond=None)[0][:2])
    with pytest.raises(ValueError):
        moments.ols(df.withColumn("x2", F.col("x") * 2), "y", ["x", "x2"])


@pytest.mark.parametrize("family", ["logit", "probit", "poisson"])
def test_likelihood_models_solve_their_score(sample, family):
    rows, df = sample
    x, y = np.array([[1.0, r[2]] for r in rows]), np.array([r[5] for r in rows], float)
    fit = moments.glm(df, "b", ["x"], family)
    z = x @ fit.coef
    if family == "probit":
        p = np.array([special.normal_cdf(v) for v in z])
        score = x.T @ (np.exp(-z * z / 2) * (y - p) / (p * (1 - p)))
        assert np.abs(score).max() < 1e-3
    else:
        p = 1 / (1 + np.exp(-z)) if family == "logit" else np.exp(z)
        assert np.abs(x.T @ (y - p)).max() < 1e-6


def test_hypothesis_tests_on_known_values(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 8.0)], "g string, v double")
    r = stats.t_test_two(df, "v", "g", "a", "b").first()
    assert r.statistic == pytest.approx(-1.7320508) and r.df == pytest.approx(4.4117647) and r.p_value == pytest.approx(0.1515805, abs=1e-6)
    r = stats.kruskal(df, "v", "g").first()
    # H = 2.083333 before the correction; two ties of two: 1 - 12 / (8**3 - 8)
    assert r.statistic == pytest.approx(2.0833333 / (1 - 12 / 504), abs=1e-6)
    assert stats.mann_whitney(df, "v", "g", "a", "b").first().statistic == 3.0
    assert stats.ks_two(df, "v", "g", "a", "b").first().statistic == 0.5
    r = stats.chisq_independence(spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10, "p string, q string"), "p", "q").first()
    assert r.statistic == pytest.approx(6.6666667) and r.df == 1 and r.cramers_v == pytest.approx(1 / 3)


def test_survival_and_series(spark):
    life = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (4.0, 0), (-1.0, 1)], "t double, e int")
    got = {r.time: r.survival for r in survival.kaplan_meier(life, "t", "e").collect()}
    assert got[1.0] == pytest.approx(0.8) and got[3.0] == pytest.approx(0.8 / 3)
    x = np.sin(np.arange(300) / 3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    c = x - x.mean()
    want = [1.0, *(float(c[k:] @ c[:-k] / (c @ c)) for k in (1, 2, 3))]
    assert [r.acf for r in series.acf(df, "x", ["i"], 3).orderBy("lag").collect()] == pytest.approx(want)
    moved = [r.moving for r in series.moving(df, "x", ["i"], 2, 1).orderBy("i").collect()]
    assert moved[5] == pytest.approx(x[3:7].mean()) and moved[0] == pytest.approx(x[:2].mean())


def test_did(spark):
    rows = [(t, p, 1.0 + t + 2 * p + 3 * t * p + d) for t in (0, 1) for p in (0, 1) for d in (-0.5, 0.5)]
    assert causal.did(spark.createDataFrame(rows, "t int, p int, y double"), "y", "t", "p").first().att == pytest.approx(3)


def test_read_only_sql(spark, people):
    assert sql.query(spark, "SELECT count(*) AS n FROM people -- drop nothing", {"people": people}).first().n == 5
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a"):
        with pytest.raises(ValueError):
            sql.read_only(bad)


def test_files_round_trip(spark, people, tmp_path):
    for ending in ("parquet", "json", "csv", "orc", "tsv"):
        path = str(tmp_path / f"p.{ending}")
        readers.write(people, path)
        assert readers.read(spark, path).count() == 5


def test_arithmetic_query_gives_what_its_sql_gives(spark, tmp_path):
    # values of every kind; a NaN tax over a zero discount came out as NaN before
    import duckdb

    from statloom.plans import munging

    kinds = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1e308, 0.05, -2.5]
    rows = [(i, 1, a, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in kinds for b in kinds for c in kinds)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_tax double").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
        want = db.execute(munging.SQL["mutate_arithmetic"]).fetchall()
    got = munging.QUERIES["mutate_arithmetic"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in want)
