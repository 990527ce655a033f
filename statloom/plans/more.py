"""Queries of the later operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, effects, forecast, inference, likelihood, moments, regress, spatial, trees
from .analysis import QUERIES as _FIRST
from .analysis import SQL as _FIRST_SQL
from .analysis import _row, query
from .munging import rounded

_SEG = "SELECT c_mktsegment g, count(*) n, avg(c_acctbal) m, var_samp(c_acctbal) v FROM customer GROUP BY 1"
_MSE = f"SELECT sum((n - 1) * v) / sum(n - 1) mse, sum(n - 1) d, sum(n) n, count(*) k FROM ({_SEG})"


@query("fivenum", "WITH r AS (SELECT c_acctbal x, row_number() OVER (ORDER BY c_acctbal) r, count(*) OVER () n FROM customer), d AS (SELECT *, ((n + 3) // 2) / 2.0 AS h FROM r) SELECT min(x) AS minimum, avg(x) FILTER (r = floor(h) OR r = ceil(h)) AS lower_hinge, median(x) AS median, avg(x) FILTER (r = floor(n + 1 - h) OR r = ceil(n + 1 - h)) AS upper_hinge, max(x) AS maximum FROM d")
def _(t):
    return inference.fivenum(t("customer"), "c_acctbal")


@query("quantiles", "SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS probability, round(unnest([quantile_cont(o_totalprice, 0.1), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.9)]), 6) AS value FROM orders")
def _(t):
    return rounded(inference.quantiles(t("orders"), "o_totalprice", [0.1, 0.5, 0.9]), 6)


@query("weighted_mean", "SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, sum(l_quantity) AS total_weight, count(*) AS n FROM lineitem")
def _(t):
    return rounded(inference.weighted_mean(t("lineitem"), "l_extendedprice", "l_quantity"), 6)


@query("weighted_covariance", "WITH m AS (SELECT sum(l_quantity) w, sum(l_quantity ** 2) q, sum(l_quantity * l_discount) / sum(l_quantity) a, sum(l_quantity * l_tax) / sum(l_quantity) b FROM lineitem), s AS (SELECT sum(l_quantity * (l_discount - a) ** 2) / max(w) / (1 - max(q) / max(w) ** 2) aa, sum(l_quantity * (l_discount - a) * (l_tax - b)) / max(w) / (1 - max(q) / max(w) ** 2) ab, sum(l_quantity * (l_tax - b) ** 2) / max(w) / (1 - max(q) / max(w) ** 2) bb FROM lineitem, m) SELECT 'l_discount' AS a, 'l_discount' AS b, round(aa, 10) AS value FROM s UNION ALL SELECT 'l_discount', 'l_tax', round(ab, 10) FROM s UNION ALL SELECT 'l_tax', 'l_discount', round(ab, 10) FROM s UNION ALL SELECT 'l_tax', 'l_tax', round(bb, 10) FROM s")
def _(t):
    return rounded(inference.weighted_covariance(t("lineitem"), ["l_discount", "l_tax"], "l_quantity"), 10)


@query("mahalanobis", "WITH s AS (SELECT avg(l_quantity) a, avg(l_discount) b, var_samp(l_quantity) aa, var_samp(l_discount) bb, covar_samp(l_quantity, l_discount) ab FROM lineitem) SELECT l_orderkey, l_linenumber, round((bb * (l_quantity - a) ** 2 - 2 * ab * (l_quantity - a) * (l_discount - b) + aa * (l_discount - b) ** 2) / (aa * bb - ab * ab), 6) AS distance FROM lineitem, s")
def _(t):
    return rounded(inference.mahalanobis(t("lineitem"), ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "distance"), 6)


@query("density")
def _(t):
    return inference.density(t("customer"), "c_acctbal", 128)


@query("proportion_test", "WITH g AS (SELECT o_orderpriority g, sum((o_orderstatus = 'F')::INT) s, count(*) n, row_number() OVER (ORDER BY o_orderpriority) k FROM orders GROUP BY 1), p AS (SELECT sum(s) / sum(n) p, sum(n * k) / sum(n) m FROM g) SELECT round(sum((s - n * p) ** 2 / (n * p * (1 - p))), 6) AS statistic, count(*) - 1.0 AS df, round(sum(k * (s - n * p)) ** 2 / (max(p) * (1 - max(p)) * sum(n * (k - m) ** 2)), 6) AS trend_statistic FROM g, p")
def _(t):
    return rounded(inference.proportion_test(t("orders"), F.col("o_orderstatus") == "F", "o_orderpriority").drop("p_value", "trend_p_value"), 6)


@query("pairwise_t", f"WITH g AS ({_SEG}), s AS ({_MSE}) SELECT a.g AS a, b.g AS b, round((a.m - b.m) / sqrt(mse * (1.0 / a.n + 1.0 / b.n)), 6) AS statistic, d::DOUBLE AS df FROM g a JOIN g b ON a.g > b.g, s")
def _(t):
    return rounded(inference.pairwise_t(t("customer"), "c_acctbal", "c_mktsegment").drop("p_value", "adjusted"), 6)


@query("tukey_hsd", f"WITH g AS ({_SEG}) SELECT a.g AS a, b.g AS b, round(a.m - b.m, 6) AS difference FROM g a JOIN g b ON a.g > b.g")
def _(t):
    return rounded(inference.tukey_hsd(t("customer"), "c_acctbal", "c_mktsegment").select("a", "b", "difference"), 6)


@query("pairwise_wilcoxon")
def _(t):
    return inference.pairwise_wilcoxon(t("customer"), "c_acctbal", "c_mktsegment")


@query("contrast", f"WITH g AS ({_SEG}), s AS ({_MSE}), c AS (SELECT sum(CASE g WHEN 'BUILDING' THEN m WHEN 'MACHINERY' THEN -m ELSE 0 END) e, sum(CASE WHEN g IN ('BUILDING', 'MACHINERY') THEN 1.0 / n ELSE 0 END) w FROM g) SELECT round(e, 6) AS estimate, round(sqrt(mse * w), 6) AS std_error, round(e / sqrt(mse * w), 6) AS statistic, d::DOUBLE AS df FROM c, s")
def _(t):
    return rounded(inference.contrast(t("customer"), "c_acctbal", "c_mktsegment", {"BUILDING": 1.0, "MACHINERY": -1.0}).drop("p_value"), 6)


@query("cell_means", "WITH m AS (SELECT avg(o_totalprice) g FROM orders), c AS (SELECT 'o_orderstatus' AS term, o_orderstatus AS level, avg(o_totalprice) a, count(*) n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, avg(o_totalprice), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus:o_orderpriority', o_orderstatus || ':' || o_orderpriority, avg(o_totalprice), count(*) FROM orders GROUP BY 2) SELECT term, level, round(a, 4) AS mean, round(a - g, 4) AS effect, n FROM c, m")
def _(t):
    return rounded(inference.cell_means(t("orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"]), 4)


_TWO = "SELECT l_returnflag g, l_quantity x, row_number() OVER (ORDER BY l_quantity) i, count(*) OVER () n FROM lineitem WHERE l_returnflag IN ('A', 'R')"


@query("mood", f"WITH r AS ({_TWO}), s AS (SELECT g, avg((i - (n + 1) / 2.0) ** 2) OVER (PARTITION BY x) a FROM r) SELECT round(sum(a) FILTER (g = 'A'), 1) AS statistic FROM s")
def _(t):
    return inference.mood(t("lineitem"), "l_quantity", "l_returnflag", "A", "R").select(F.round("statistic", 1).alias("statistic"))


@query("ansari", f"WITH r AS ({_TWO}), s AS (SELECT g, avg(least(i, n + 1 - i)) OVER (PARTITION BY x) a FROM r) SELECT round(sum(a) FILTER (g = 'A'), 2) AS statistic FROM s")
def _(t):
    return inference.ansari(t("lineitem"), "l_quantity", "l_returnflag", "A", "R").select(F.round("statistic", 2).alias("statistic"))


@query("fligner")
def _(t):
    return inference.fligner(t("customer"), "c_acctbal", "c_mktsegment")


@query("mantel_haenszel", "WITH c AS (SELECT l_linenumber k, sum((l_returnflag = 'R' AND l_linestatus = 'F')::INT)::DOUBLE p, sum((l_returnflag = 'R' AND l_linestatus <> 'F')::INT)::DOUBLE q, sum((l_returnflag <> 'R' AND l_linestatus = 'F')::INT)::DOUBLE r, sum((l_returnflag <> 'R' AND l_linestatus <> 'F')::INT)::DOUBLE s, count(*) n FROM lineitem GROUP BY 1), t AS (SELECT sum(p - (p + q) * (p + r) / n) d, sum((p + q) * (p + r) * (q + s) * (r + s) / (n * n * (n - 1))) v, sum(p * s / n) a, sum(q * r / n) b, count(*) k FROM c) SELECT round((abs(d) - 0.5) ** 2 / v, 4) AS statistic, 1.0::DOUBLE AS df, round(a / b, 6) AS odds_ratio, k AS strata FROM t")
def _(t):
    rows = t("lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_linestatus") == "F").cast("int").alias("b"))
    return inference.mantel_haenszel(rows, "a", "b", "l_linenumber").select(F.round("statistic", 4).alias("statistic"), "df", F.round("odds_ratio", 6).alias("odds_ratio"), "strata")


@query("loglinear", "WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*) n FROM orders GROUP BY 1, 2), f AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER ()::DOUBLE e, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) d FROM c) SELECT round(2 * sum(n * ln(n / e)), 6) AS likelihood_ratio, round(sum((n - e) ** 2 / e), 6) AS pearson, max(d)::INT AS df FROM f")
def _(t):
    return rounded(inference.loglinear(t("orders"), ["o_orderstatus", "o_orderpriority"], [["o_orderstatus"], ["o_orderpriority"]]).drop("p_likelihood_ratio", "p_pearson"), 6)


@query("manova")
def _(t):
    return inference.manova(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")


@query("mauchly")
def _(t):
    return inference.mauchly(t("lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query("shapiro_wilk")
def _(t):
    return inference.shapiro_wilk(t("customer"), "c_acctbal")


@query("ks_one", "WITH r AS (SELECT c_acctbal x, count(*) c FROM customer GROUP BY 1), s AS (SELECT least(greatest((x + 1000) / 11000, 0), 1) f, sum(c) OVER (ORDER BY x) u, sum(c) OVER (ORDER BY x) - c l, sum(c) OVER () n FROM r) SELECT round(max(greatest(u / n - f, f - l / n)), 8) AS statistic, max(n)::BIGINT AS n FROM s")
def _(t):
    return inference.ks_one(t("customer"), "c_acctbal", "uniform", -1000, 10000).select(F.round("statistic", 8).alias("statistic"), "n")


@query("median_polish")
def _(t):
    return inference.median_polish(t("lineitem"), "l_extendedprice", "l_returnflag", "l_linenumber")


@query("canonical_correlation", "WITH r AS (SELECT corr(l_extendedprice, l_quantity) a, corr(l_extendedprice, l_discount) b, corr(l_quantity, l_discount) c FROM lineitem) SELECT 1 AS component, round(sqrt((a * a + b * b - 2 * a * b * c) / (1 - c * c)), 8) AS correlation FROM r")
def _(t):
    return rounded(inference.canonical_correlations(t("lineitem"), ["l_extendedprice"], ["l_quantity", "l_discount"]).select("component", "correlation"), 8)


@query("factor_analysis")
def _(t):
    return inference.factor_analysis(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 1)


@query("isotonic")
def _(t):
    return inference.isotonic(t("lineitem"), "l_quantity", "l_extendedprice")


@query("power")
def _(t):
    return _row(t("region").sparkSession, ("proportions", "anova"), (inference.power_proportions(200, 0.4, 0.5), inference.power_anova(4, 20, 1, 9)))


@query("quade")
def _(t):
    x = t("lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("x"))
    return inference.quade(x, "x", "l_returnflag", "l_linenumber")


for _kind in ("hac", "driscoll_kraay", "bootstrap"):

    @query(f"ols_{_kind}")
    def _(t, kind=_kind):
        e = t("events").select("event_id", "value", (F.col("event_id") % 97).cast("double").alias("x"), F.to_date("ts").alias("day"))
        fit = {"hac": lambda: regress.hac(e, "value", ["x"], ["event_id"]), "driscoll_kraay": lambda: regress.driscoll_kraay(e, "value", ["x"], "day"), "bootstrap": lambda: regress.bootstrap(e, "value", ["x"], "event_id")}[kind]()
        return fit.frame(e.sparkSession)


@query("gls_ar1")
def _(t):
    e = t("events").select("event_id", "value", (F.col("event_id") % 97).cast("double").alias("x"))
    return regress.gls_ar1(e, "value", ["x"], ["event_id"]).frame(e.sparkSession)


@query("breusch_godfrey")
def _(t):
    e = t("events").select("event_id", "value", (F.col("event_id") % 97).cast("double").alias("x"))
    return _row(e.sparkSession, ("statistic", "df", "p_value"), regress.breusch_godfrey(e, "value", ["x"], ["event_id"], 2))


@query("harvey_collier")
def _(t):
    e = t("events").select("event_id", "value", (F.col("event_id") % 97).cast("double").alias("x"))
    return _row(e.sparkSession, ("statistic", "df", "p_value"), regress.harvey_collier(e, "value", ["x"], ["event_id"]))


@query("panel_gls")
def _(t):
    li = t("lineitem")
    return regress.panel_gls(li, "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey").frame(li.sparkSession)


@query("gmm_iv")
def _(t):
    li = t("lineitem").withColumn("z", F.col("l_quantity") + F.col("l_linenumber"))
    return regress.gmm_iv(li, "l_extendedprice", [], ["l_quantity"], ["z", "l_tax"]).frame(li.sparkSession)


@query("nls")
def _(t):
    li = t("lineitem").where("l_quantity > 0")
    return regress.nls(li, "l_extendedprice", regress.CURVES["power"][1](F.col("l_quantity").cast("double")), {"a": 1000.0, "b": 1.0}).frame(li.sparkSession)


@query("stepwise")
def _(t):
    return regress.step(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


_SXY = "SELECT count(*) n, regr_syy(l_extendedprice, l_quantity) syy, regr_sxx(l_extendedprice, l_quantity) sxx, regr_sxy(l_extendedprice, l_quantity) sxy FROM lineitem"


@query("drop_one", f"WITH s AS ({_SXY}), r AS (SELECT n, syy, syy - sxy * sxy / sxx e FROM s) SELECT '<none>' AS term, round(e / 1e9, 4) AS rss, round(n * ln(e / n) + 4, 4) AS aic, NULL::DOUBLE AS statistic FROM r UNION ALL SELECT 'l_quantity', round(syy / 1e9, 4), round(n * ln(syy / n) + 2, 4), round((syy - e) / (e / (n - 2)), 2) FROM r")
def _(t):
    r = regress.drop_one(t("lineitem"), "l_extendedprice", ["l_quantity"])
    return r.select("term", F.round(F.col("rss") / 1e9, 4).alias("rss"), F.round("aic", 4).alias("aic"), F.round("statistic", 2).alias("statistic"))


@query("anova_of_regression", f"WITH s AS ({_SXY}), r AS (SELECT n, sxy * sxy / sxx m, syy - sxy * sxy / sxx e FROM s) SELECT 'l_quantity' AS term, 1.0::DOUBLE AS df, round(m / 1e9, 4) AS ss, round(m / (e / (n - 2)), 2) AS statistic FROM r UNION ALL SELECT 'residuals', n - 2.0, round(e / 1e9, 4), NULL FROM r")
def _(t):
    r = regress.anova_of(t("lineitem"), "l_extendedprice", ["l_quantity"])
    return r.select("term", "df", F.round(F.col("ss") / 1e9, 4).alias("ss"), F.round("statistic", 2).alias("statistic"))


@query("elastic_net_cv")
def _(t):
    return regress.elastic_net_cv(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "l_orderkey", [1.0, 100.0, 1000.0])


for _curve in ("loess", "smooth_spline", "super_smoother", "resistant_line"):

    @query(_curve)
    def _(t, f=getattr(regress, _curve)):
        return f(t("lineitem"), "l_quantity", "l_extendedprice")


@query("quantile_regressions")
def _(t):
    return regress.quantile_regressions(t("lineitem"), "l_extendedprice", ["l_quantity"], [0.25, 0.75])


@query("sensitivity")
def _(t):
    li = t("lineitem")
    s = regress.sensitivity(moments.ols(li, "l_extendedprice", ["l_quantity", "l_discount"]), "l_discount")
    return _row(li.sparkSession, tuple(s), tuple(s.values()))


@query("e_values", "SELECT round(3.9 + sqrt(3.9 * 2.9), 8) AS e_value, round(1.8 + sqrt(1.8 * 0.8), 8) AS e_value_limit, 3.9::DOUBLE AS ratio")
def _(t):
    s = regress.e_values(3.9, 1.8, 8.7)
    return rounded(_row(t("region").sparkSession, tuple(s), tuple(s.values())), 8)


def _counts(t):
    """Urgent orders of each customer; those of some nations count none."""
    n = t("orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.when(F.col("c_nationkey") % 4 == 0, 0).otherwise(F.coalesce("n", F.lit(0))).alias("y"), (F.col("c_acctbal") / 10000).cast("double").alias("q"))


@query("logit_binary", "WITH c AS (SELECT sum((l_returnflag = 'R' AND l_linestatus = 'F')::INT) a, sum((l_returnflag <> 'R' AND l_linestatus = 'F')::INT) b, sum((l_returnflag = 'R' AND l_discount > 0.05)::INT) u, sum((l_returnflag <> 'R' AND l_discount > 0.05)::INT) v, sum((l_returnflag = 'R' AND l_discount <= 0.05)::INT) w, sum((l_returnflag <> 'R' AND l_discount <= 0.05)::INT) x FROM lineitem) SELECT '(Intercept)' AS term, round(ln(w / x), 6) AS estimate, round(sqrt(1.0 / w + 1.0 / x), 6) AS std_error FROM c UNION ALL SELECT 'd', round(ln(u / v) - ln(w / x), 6), round(sqrt(1.0 / u + 1.0 / v + 1.0 / w + 1.0 / x), 6) FROM c")
def _(t):
    li = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("d"))
    return rounded(moments.glm(li, "y", ["d"], "logit").frame(li.sparkSession).select("term", "estimate", "std_error"), 6)


@query("poisson_binary", "WITH c AS (SELECT sum(l_linenumber) FILTER (l_discount > 0.05) a, count(*) FILTER (l_discount > 0.05) n, sum(l_linenumber) FILTER (l_discount <= 0.05) b, count(*) FILTER (l_discount <= 0.05) m FROM lineitem) SELECT '(Intercept)' AS term, round(ln(b / m), 6) AS estimate, round(sqrt(1.0 / b), 6) AS std_error FROM c UNION ALL SELECT 'd', round(ln(a / n) - ln(b / m), 6), round(sqrt(1.0 / a + 1.0 / b), 6) FROM c")
def _(t):
    li = t("lineitem").select("l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("d"))
    return rounded(moments.glm(li, "l_linenumber", ["d"], "poisson").frame(li.sparkSession).select("term", "estimate", "std_error"), 6)


@query("negative_binomial")
def _(t):
    return likelihood.negative_binomial(_counts(t), "y", ["q"]).frame(t("region").sparkSession)


for _family in ("poisson", "negative_binomial"):

    @query(f"zero_inflated_{_family}")
    def _(t, family=_family):
        return likelihood.zero_inflated(_counts(t), "y", ["q"], [], family).frame(t("region").sparkSession)


@query("hurdle")
def _(t):
    return likelihood.hurdle(_counts(t), "y", ["q"])[1].frame(t("region").sparkSession)


for _link in ("logit", "probit"):

    @query(f"ordered_{_link}")
    def _(t, link=_link):
        rows = _counts(t).withColumn("y", F.least("y", F.lit(2)))
        return likelihood.ordered(rows, "y", ["q"], link).frame(rows.sparkSession)


@query("multinomial_logit", "WITH c AS (SELECT l_returnflag f, sum((l_discount > 0.05)::INT) a, sum((l_discount <= 0.05)::INT) b FROM lineitem GROUP BY 1), z AS (SELECT a a0, b b0 FROM c WHERE f = 'A') SELECT f || ':(Intercept)' AS term, round(ln(b / b0), 6) AS estimate FROM c, z WHERE f <> 'A' UNION ALL SELECT f || ':d', round(ln(a / a0) - ln(b / b0), 6) FROM c, z WHERE f <> 'A'")
def _(t):
    li = t("lineitem").select("l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("d"))
    return rounded(likelihood.multinomial(li, "l_returnflag", ["d"]).frame(li.sparkSession).select("term", "estimate"), 6)


@query("conditional_logit")
def _(t):
    li = t("lineitem").select("l_orderkey", (F.col("l_linenumber") == 1).cast("int").alias("hit"), (F.col("l_quantity") / 10).cast("double").alias("q"), "l_discount")
    return likelihood.conditional(li, "hit", ["q", "l_discount"], "l_orderkey").frame(li.sparkSession)


for _dist in ("weibull", "lognormal"):

    @query(f"aft_{_dist}")
    def _(t, dist=_dist):
        li = t("lineitem").select(F.col("l_quantity").cast("double").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"), "l_discount")
        return likelihood.accelerated_failure(li, "t", "e", ["l_discount"], dist).frame(li.sparkSession)


@query("aft_exponential", "WITH c AS (SELECT sum(l_quantity) t, sum((l_returnflag = 'R')::INT) d FROM lineitem WHERE l_discount > 0.05), b AS (SELECT sum(l_quantity) t, sum((l_returnflag = 'R')::INT) d FROM lineitem WHERE l_discount <= 0.05) SELECT '(Intercept)' AS term, round(ln(b.t / b.d), 5) AS estimate FROM b UNION ALL SELECT 'x', round(ln(c.t / c.d) - ln(b.t / b.d), 5) FROM b, c")
def _(t):
    li = t("lineitem").select(F.col("l_quantity").cast("double").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"), (F.col("l_discount") > 0.05).cast("int").alias("x"))
    return rounded(likelihood.accelerated_failure(li, "t", "e", ["x"], "exponential").frame(li.sparkSession).select("term", "estimate"), 5)


@query("tobit")
def _(t):
    c = t("customer").select(F.greatest("c_acctbal", F.lit(0.0)).alias("y"), (F.col("c_nationkey") / 10).alias("x"))
    return likelihood.tobit(c.select((F.col("y") / 1000).alias("y"), "x"), "y", ["x"]).frame(c.sparkSession)


@query("marginal_effects", "WITH c AS (SELECT sum((l_returnflag = 'R' AND l_discount > 0.05)::INT) / sum((l_discount > 0.05)::INT) p, sum((l_returnflag = 'R' AND l_discount <= 0.05)::INT) / sum((l_discount <= 0.05)::INT) q, avg((l_discount > 0.05)::INT) s FROM lineitem) SELECT 'd' AS term, round((ln(p / (1 - p)) - ln(q / (1 - q))) * (s * p * (1 - p) + (1 - s) * q * (1 - q)), 8) AS effect FROM c")
def _(t):
    li = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("d"))
    return rounded(likelihood.marginal_effects(li, moments.glm(li, "y", ["d"], "logit"), ["d"]).select("term", "effect"), 8)


def _treated(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("d"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("x"), F.xxhash64("l_orderkey", "l_linenumber").alias("id"))


@query("match_nearest")
def _(t):
    return effects.nearest_match(_treated(t), "y", "d", ["q", "x"])


@query("match_cells", "WITH c AS (SELECT l_linestatus s, l_linenumber k, count(*) FILTER (l_returnflag = 'R') nt, count(*) FILTER (l_returnflag <> 'R') nc, avg(l_extendedprice) FILTER (l_returnflag = 'R') yt, avg(l_extendedprice) FILTER (l_returnflag <> 'R') yc FROM lineitem GROUP BY 1, 2) SELECT round(sum(nt * (yt - yc)) FILTER (nt > 0 AND nc > 0) / sum(nt) FILTER (nt > 0 AND nc > 0), 4) AS effect, (sum(nt) FILTER (nt > 0 AND nc > 0))::BIGINT AS matched, sum(nt)::BIGINT AS treated, count(*) FILTER (nt > 0 AND nc > 0) AS cells FROM c")
def _(t):
    rows = t("lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("d"), "l_linestatus", F.col("l_linenumber").cast("string").alias("k"))
    return effects.exact_cells(rows, "l_extendedprice", "d", ["l_linestatus", "k"]).withColumn("effect", F.round("effect", 4))


@query("match_subclass")
def _(t):
    return effects.subclasses(_treated(t), "y", "d", ["q", "x"])


@query("entropy_balance")
def _(t):
    return effects.entropy_balance(_treated(t), "y", "d", ["q", "x"])


@query("balance_table", "WITH s AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') a, avg(l_quantity) FILTER (l_returnflag <> 'R') b, var_samp(l_quantity) FILTER (l_returnflag = 'R') v, var_samp(l_quantity) FILTER (l_returnflag <> 'R') w, var_pop(l_quantity) FILTER (l_returnflag = 'R') p, var_pop(l_quantity) FILTER (l_returnflag <> 'R') q FROM lineitem) SELECT 'q' AS term, round((a - b) / sqrt((v + w) / 2), 6) AS difference, round(p / q, 6) AS ratio FROM s")
def _(t):
    return rounded(effects.balance(_treated(t), "d", ["q"]), 6)


@query("double_ml")
def _(t):
    return effects.double_ml(_treated(t), "y", "d", ["q", "x"], "id")


@query("g_formula", "WITH c AS (SELECT (l_discount > 0.05)::INT x, avg(l_extendedprice) FILTER (l_returnflag = 'R') a, avg(l_extendedprice) FILTER (l_returnflag <> 'R') b, count(*) n FROM lineitem GROUP BY 1) SELECT round(sum(n * a) / sum(n), 4) AS treated, round(sum(n * b) / sum(n), 4) AS control, round(sum(n * (a - b)) / sum(n), 4) AS effect, round(sum(n * a) / sum(n * b), 6) AS ratio FROM c")
def _(t):
    rows = _treated(t).withColumn("b", (F.col("x") > 0.05).cast("int"))
    s = effects.standardized(rows, "y", "d", ["b"])
    return s.select(F.round("treated", 4).alias("treated"), F.round("control", 4).alias("control"), F.round("effect", 4).alias("effect"), F.round("ratio", 6).alias("ratio"))


@query("tmle")
def _(t):
    return effects.tmle(_treated(t), "y", "d", ["q", "x"])


@query("mediation", "WITH s AS (SELECT regr_slope(l_quantity, (l_returnflag = 'R')::INT) a, covar_pop(l_extendedprice, (l_returnflag = 'R')::INT) yd, covar_pop(l_extendedprice, l_quantity) ym, covar_pop(l_quantity, (l_returnflag = 'R')::INT) md, var_pop((l_returnflag = 'R')::INT) dd, var_pop(l_quantity) mm FROM lineitem), c AS (SELECT a, (ym * dd - yd * md) / (dd * mm - md * md) b, (yd * mm - ym * md) / (dd * mm - md * md) c FROM s) SELECT 'indirect' AS path, round(a * b, 4) AS effect FROM c UNION ALL SELECT 'direct', round(c, 4) FROM c UNION ALL SELECT 'total', round(a * b + c, 4) FROM c")
def _(t):
    return rounded(effects.mediation(_treated(t), "y", "d", "q").where("path <> 'share'").drop("std_error"), 4)


def _panel(t):
    g = F.when(F.col("l_suppkey") % 3 != 0, (1994 + F.col("l_suppkey") % 3).cast("int"))
    return t("lineitem").groupBy(F.col("l_suppkey").alias("u"), F.year("l_shipdate").alias("t"), g.alias("g")).agg(F.avg("l_quantity").alias("y"))


@query("bacon")
def _(t):
    return effects.bacon(_panel(t), "y", "u", "t", "g")


@query("synthetic_control")
def _(t):
    return effects.synthetic_control(_panel(t).where("u <= 30"), "y", "u", "t", 1, 1996)[1]


@query("fuzzy_rd")
def _(t):
    rows = _treated(t).withColumn("take", (F.col("q") + F.col("l_linenumber") >= 28).cast("int"))
    return effects.fuzzy_rd(rows, "y", "take", "q", 25, 10)


@query("rd_bandwidth")
def _(t):
    return _row(t("region").sparkSession, ("bandwidth",), (effects.rd_bandwidth(_treated(t), "y", "q", 25),))


@query("iv_bounds")
def _(t):
    rows = t("lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("z"), (F.col("l_returnflag") == "R").cast("int").alias("d"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    return effects.iv_bounds(rows, "y", "d", "z")


@query("panel_unit_root", "WITH d AS (SELECT user_id, lag(value) OVER w x, value - lag(value) OVER w y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT user_id, regr_slope(y, x) b, regr_sxx(y, x) sxx, regr_syy(y, x) syy, count(*) n FROM d WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) > 3 AND regr_sxx(y, x) > 0) SELECT round(avg(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)), 6) AS mean_t, count(*) AS entities FROM g")
def _(t):
    return rounded(effects.panel_unit_root(t("events"), "value", "user_id", ["event_id"]), 6)


def _days(t):
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


for _name, _make in {
    "ar": lambda d: forecast.ar(d, "v", ["day"], ["event_type"], 3),
    "arima": lambda d: forecast.arima(d, "v", ["day"], ["event_type"], (1, 0, 1), 5),
    "stl": lambda d: forecast.stl(d, "v", ["day"], ["event_type"], 7),
    "mstl": lambda d: forecast.mstl(d, "v", ["day"], ["event_type"], [7]),
    "change_points": lambda d: forecast.changes(d, "v", ["day"], ["event_type"]),
    "binary_segmentation": lambda d: forecast.changes(d, "v", ["day"], ["event_type"], "binary"),
    "structural_series": lambda d: forecast.structural(d, "v", ["day"], ["event_type"]),
    "garch": lambda d: forecast.garch(d, "v", ["day"], ["event_type"]),
    "spectrum": lambda d: forecast.spectrum(d, "v", ["day"], ["event_type"]),
    "spectrum_ar": lambda d: forecast.spectrum_ar(d, "v", ["day"], ["event_type"], 50),
    "white_noise": lambda d: forecast.white_noise(d, "v", ["day"], ["event_type"]),
    "phillips_perron": lambda d: forecast.phillips_perron(d, "v", ["day"], ["event_type"]),
    "linear_filter": lambda d: forecast.linear_filter(d, "v", ["day"], ["event_type"], [0.25, 0.5, 0.25]),
}.items():

    @query(_name)
    def _(t, make=_make):
        return make(_days(t))


@query("embedded", "SELECT event_id, user_id, lag1, lag2 FROM (SELECT event_id, user_id, lag(value, 1) OVER w lag1, lag(value, 2) OVER w lag2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE lag2 IS NOT NULL AND lag1 IS NOT NULL")
def _(t):
    return forecast.embedded(t("events").select("event_id", "user_id", "value"), "value", ["event_id"], 3, ["user_id"]).drop("value")


@query("cointegration")
def _(t):
    e = t("events").select("event_id", F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 7).alias("b"))
    return forecast.cointegration(e, ["a", "b"], ["event_id"])


def _grid(t):
    return t("customer").select("c_custkey", (F.col("c_custkey") % 40).alias("x"), F.floor(F.col("c_custkey") / 40).alias("y"), F.col("c_acctbal").cast("double").alias("v"), (F.col("c_nationkey") * 1.0).cast("double").alias("z"))


_GRID = "SELECT c_custkey i, c_custkey % 40 x, c_custkey // 40 y, c_acctbal v FROM customer"
_NEAR = f"SELECT a.i, a.v, b.v u, 1.0 / count(*) OVER (PARTITION BY a.i) w FROM ({_GRID}) a JOIN ({_GRID}) b ON a.i <> b.i AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1.5 * 1.5"


@query("spatial_moran", f"WITH p AS ({_NEAR}), m AS (SELECT avg(c_acctbal) m, var_pop(c_acctbal) * count(*) s, count(*) n FROM customer) SELECT round(max(n) / sum(w) * sum(w * (v - m) * (u - m)) / max(s), 8) AS statistic, -1.0 / (max(n) - 1) AS expectation FROM p, m")
def _(t):
    g = _grid(t)
    return spatial.moran(g, spatial.neighbours(g, "c_custkey", "x", "y", 1.5), "c_custkey", "v").select(F.round("statistic", 8).alias("statistic"), "expectation")


@query("spatial_geary", f"WITH p AS ({_NEAR}), m AS (SELECT var_pop(c_acctbal) * count(*) s, count(*) n FROM customer) SELECT round((max(n) - 1) * sum(w * (v - u) ** 2) / (2 * sum(w) * max(s)), 8) AS statistic FROM p, m")
def _(t):
    g = _grid(t)
    return spatial.geary(g, spatial.neighbours(g, "c_custkey", "x", "y", 1.5), "c_custkey", "v").select(F.round("statistic", 8).alias("statistic"))


@query("local_moran", f"WITH p AS ({_NEAR}), m AS (SELECT avg(c_acctbal) m, var_pop(c_acctbal) s FROM customer) SELECT i AS c_custkey, round((max(v) - max(m)) * sum(w * (u - m)) / max(s), 6) AS statistic FROM p, m GROUP BY 1")
def _(t):
    g = _grid(t)
    return rounded(spatial.local_moran(g, spatial.neighbours(g, "c_custkey", "x", "y", 1.5), "c_custkey", "v").drop("quadrant"), 6)


for _name, _make in {
    "spatial_lag": lambda g, w: spatial.spatial_lag(g, w, "c_custkey", "v", ["z"]).frame(g.sparkSession),
    "spatial_error": lambda g, w: spatial.spatial_error(g, w, "c_custkey", "v", ["z"]).frame(g.sparkSession),
    "spatial_tests": lambda g, w: spatial.lag_tests(g, w, "c_custkey", "v", ["z"]),
}.items():

    @query(_name)
    def _(t, make=_make):
        g = _grid(t)
        return make(g, spatial.neighbours(g, "c_custkey", "x", "y", 1.5))


def _classed(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("k"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_discount") * 100).cast("double").alias("b"), F.col("l_extendedprice").cast("double").alias("v"))


for _name, _make in {
    "cart": lambda d: trees.cart(d, "k", ["a", "b"]).predict(d),
    "random_forest": lambda d: trees.random_forest(d, "k", ["a", "b"], trees=10, depth=4).predict(d),
    "gradient_boosting": lambda d: trees.gradient_boosting(d, "v", ["a", "b"], False, 5).predict(d),
    "linear_svm": lambda d: trees.linear_svm(d, "k", ["a", "b"], rounds=20).predict(d),
    "adaboost": lambda d: trees.adaboost(d, "k", ["b", "v"], 5).predict(d),
    "partial_dependence": lambda d: trees.partial_dependence(d, trees.cart(d, "v", ["a", "b"], False), "a", [10.0, 25.0, 40.0]),
    "importance": lambda d: trees.random_forest(d, "v", ["a", "b"], False, 10, 4).importance(d.sparkSession),
}.items():

    @query(_name)
    def _(t, make=_make):
        out = make(_classed(t))
        return out.select("l_orderkey", "l_linenumber", "predicted") if "l_orderkey" in out.columns else out


def _spots(t):
    return t("customer").select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_acctbal") / 1000).cast("double").alias("a"), (F.col("c_nationkey") * 1.0).cast("double").alias("b"), (F.col("c_nationkey") % 3).cast("int").alias("k"), F.when(F.col("c_acctbal") > 4000, 1).otherwise(0).alias("h"))


for _name, _make in {
    "gaussian_mixture": lambda d: cluster.gaussian_mixture(d, ["a", "b"], "id", 3)[0].select("id", "cluster"),
    "bisecting_kmeans": lambda d: cluster.bisecting_kmeans(d, ["a", "b"], "id", 4),
    "spherical_kmeans": lambda d: cluster.spherical_kmeans(d.withColumn("b", F.col("b") + 1), ["a", "b"], "id", 3),
    "trimmed_kmeans": lambda d: cluster.trimmed_kmeans(d, ["a", "b"], "id", 3),
    "fuzzy_cmeans": lambda d: cluster.fuzzy_cmeans(d, ["a", "b"], "id", 3)[0],
    "dbscan": lambda d: cluster.dbscan(d, ["a", "b"], "id", 0.4, 4),
    "hierarchical": lambda d: cluster.hierarchical(d, ["a", "b"], "id"),
    "kmedoids": lambda d: cluster.kmedoids(d, ["a", "b"], "id", 3),
    "minimum_spanning_tree": lambda d: cluster.mst(d, ["a", "b"], "id"),
    "classical_scaling": lambda d: cluster.classical_scaling(d, ["a", "b"], "id"),
    "gap_statistic": lambda d: cluster.gap_statistic(d, ["a", "b"], 3, 2),
    "normal_mixture": lambda d: cluster.normal_mixture(d, "a", 2),
}.items():

    @query(_name)
    def _(t, make=_make):
        return make(_spots(t))


@query("calinski_harabasz", "WITH g AS (SELECT c_nationkey % 3 k, count(*) n, avg(c_acctbal / 1000) a, avg(c_nationkey) b, var_pop(c_acctbal / 1000) + var_pop(c_nationkey) v FROM customer GROUP BY 1), m AS (SELECT avg(c_acctbal / 1000) x, avg(c_nationkey) y FROM customer) SELECT round((sum(n * ((a - x) ** 2 + (b - y) ** 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS score FROM g, m")
def _(t):
    return rounded(_row(t("region").sparkSession, ("score",), (cluster.calinski_harabasz(_spots(t), ["a", "b"], "k"),)), 6)


@query("cluster_scores")
def _(t):
    d = _spots(t)
    return _row(d.sparkSession, ("davies_bouldin", "silhouette"), (cluster.davies_bouldin(d, ["a", "b"], "k"), cluster.silhouette(d, ["a", "b"], "k")))


@query("rand_index", "WITH c AS (SELECT c_nationkey % 3 a, (c_acctbal > 4000)::INT b, count(*) n FROM customer GROUP BY 1, 2), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) x, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) s FROM c GROUP BY a)) a, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) s FROM c GROUP BY b)) b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) w) SELECT round((w + 2 * x - a - b) / w, 8) AS rand FROM t")
def _(t):
    return rounded(_row(t("region").sparkSession, ("rand",), (cluster.agreement(_spots(t), "k", "h")["rand"],)), 8)


#: SQL of earlier queries that had none.
EARLIER_SQL = {
    "ljung_box": "WITH s AS (SELECT value - avg(value) OVER () x, event_id, count(*) OVER () n FROM events), l AS (SELECT n, x, lag(x, 1) OVER w a, lag(x, 2) OVER w b, lag(x, 3) OVER w c, lag(x, 4) OVER w d, lag(x, 5) OVER w e FROM s WINDOW w AS (ORDER BY event_id)), r AS (SELECT max(n)::DOUBLE n, sum(x * a) / sum(x * x) a, sum(x * b) / sum(x * x) b, sum(x * c) / sum(x * x) c, sum(x * d) / sum(x * x) d, sum(x * e) / sum(x * x) e FROM l) SELECT round(n * (n + 2) * (a * a / (n - 1) + b * b / (n - 2) + c * c / (n - 3) + d * d / (n - 4) + e * e / (n - 5)), 6) AS statistic, 5.0::DOUBLE AS df FROM r",
    "breusch_pagan": "WITH s AS (SELECT avg(l_extendedprice) my, avg(l_quantity) m1, avg(l_discount) m2, covar_pop(l_extendedprice, l_quantity) y1, covar_pop(l_extendedprice, l_discount) y2, covar_pop(l_quantity, l_discount) s12, var_pop(l_quantity) s11, var_pop(l_discount) s22 FROM lineitem), b AS (SELECT *, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) b1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) b2 FROM s), e AS (SELECT (l_extendedprice - my - b1 * (l_quantity - m1) - b2 * (l_discount - m2)) ** 2 u, l_quantity a, l_discount d FROM lineitem, b), r AS (SELECT corr(u, a) r1, corr(u, d) r2, corr(a, d) r12, count(*) n FROM e) SELECT round(n * (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12), 4) AS statistic, 2.0::DOUBLE AS df FROM r",
    "competing_risks": "WITH r AS (SELECT l_quantity t, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END c FROM lineitem), b AS (SELECT t, count(*) n, sum((c > 0)::INT) d, sum((c = 1)::INT) k1, sum((c = 2)::INT) k2 FROM r GROUP BY 1), a AS (SELECT *, sum(n) OVER (ORDER BY t DESC) risk FROM b), q AS (SELECT *, ln(greatest(1 - d / risk, 1e-300)) q FROM a), s AS (SELECT *, exp(sum(q) OVER (ORDER BY t) - q) before FROM q) SELECT t AS time, 1 AS cause, round(sum(before * k1 / risk) OVER (ORDER BY t), 6) AS incidence FROM s UNION ALL SELECT t, 2, round(sum(before * k2 / risk) OVER (ORDER BY t), 6) FROM s",
    "decompose": "WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 i, count(*) OVER () n FROM events), m AS (SELECT *, CASE WHEN i >= 6 AND i < n - 6 THEN (avg(value) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(value) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 END trend FROM r), s AS (SELECT i % 12 k, avg(value - trend) m FROM m GROUP BY 1), c AS (SELECT k, m - (SELECT avg(m) FROM s) seasonal FROM s) SELECT event_id, value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS remainder FROM m JOIN c ON i % 12 = k",
    "moran": f"WITH p AS ({_NEAR}), m AS (SELECT avg(c_acctbal) m, var_pop(c_acctbal) * count(*) s, count(*) n FROM customer) SELECT round(max(n) / count(DISTINCT i) * sum(w * (v - m) * (u - m)) / max(s), 8) AS moran_i, max(n) AS n, count(DISTINCT i) AS with_neighbours FROM p, m",
    "iv_first_stage": "WITH r AS (SELECT corr(l_quantity, l_quantity + l_linenumber) xz, corr(l_quantity, l_tax) xt, corr(l_quantity + l_linenumber, l_tax) zt, count(*) n FROM lineitem), p AS (SELECT n, (xz - xt * zt) ** 2 / ((1 - xt * xt) * (1 - zt * zt)) q FROM r) SELECT round(q * (n - 3) / (1 - q), 2) AS statistic FROM p",
    "ipw_binary_ate": "WITH c AS (SELECT (l_discount > 0.05)::INT x, avg(l_extendedprice) FILTER (l_returnflag = 'R') a, avg(l_extendedprice) FILTER (l_returnflag <> 'R') b, count(*) n FROM lineitem GROUP BY 1) SELECT 'ate' AS estimand, round(sum(n * (a - b)) / sum(n), 4) AS effect, sum(n)::BIGINT AS n FROM c",
}


def _rounded_as(name: str, digits: dict[str, int], *drop: str):
    """The earlier query with rounded columns and without those that SQL can't say."""
    first = _FIRST[name]

    def run(spark, sf_dir):
        df = first(spark, sf_dir).drop(*drop)
        return df.withColumns({c: F.round(c, d) for c, d in digits.items()})

    _FIRST[name] = run


_rounded_as("ljung_box", {"statistic": 6}, "p_value")
_rounded_as("breusch_pagan", {"statistic": 4}, "p_value")
_rounded_as("competing_risks", {"incidence": 6})
_rounded_as("decompose", {"trend": 6, "seasonal": 6, "remainder": 6})
_rounded_as("moran", {"moran_i": 8})
_rounded_as("iv_first_stage", {"statistic": 2}, "p_value")


@query("ipw_binary_ate", EARLIER_SQL["ipw_binary_ate"])
def _(t):
    from ..operators import causal

    rows = _treated(t).withColumn("b", (F.col("x") > 0.05).cast("int"))
    return causal.ipw(rows, "y", "d", ["b"]).withColumn("effect", F.round("effect", 4))


_FIRST_SQL.update(EARLIER_SQL)
