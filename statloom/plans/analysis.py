"""Queries of the statistical operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causal, learn, models, moments, series, stats, survival
from .munging import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    """Register a query over (tables by name)."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if statement:
            SQL[name] = statement
        return f

    return put


def _six(df: DataFrame, *drop: str) -> DataFrame:
    return rounded(df.drop("p_value", *drop), 6)


@query("moments", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, round((avg(o_totalprice ** 3) - 3 * avg(o_totalprice) * avg(o_totalprice ** 2) + 2 * avg(o_totalprice) ** 3) / stddev_pop(o_totalprice) ** 3, 4) AS skewness FROM orders")
def _(t):
    m = stats.moments(t("orders"), "o_totalprice")
    return m.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("skewness", 4).alias("skewness"))


@query("robust_statistics", "WITH q AS (SELECT median(c_acctbal) m, quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.75) b, count(*) n, floor(count(*) * 0.1)::INT k FROM customer), s AS (SELECT c_acctbal x, row_number() OVER (ORDER BY c_acctbal) r FROM customer), w AS (SELECT sum(x) FILTER (r > k AND r <= n - k) s, min(x) FILTER (r > k AND r <= n - k) lo, max(x) FILTER (r > k AND r <= n - k) hi, max(n) n, max(k) k FROM s, q) SELECT w.n AS n, round(m, 6) AS median, round((SELECT median(abs(c_acctbal - m)) FROM customer, q) * 1.4826, 6) AS mad, round(b - a, 6) AS iqr, round(s / (w.n - 2 * w.k), 6) AS trimmed_mean, round((s + w.k * (lo + hi)) / w.n, 6) AS winsorized_mean FROM q, w")
def _(t):
    return _six(stats.robust(t("customer"), "c_acctbal"))


@query("t_test_one", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS statistic, count(*) - 1.0 AS df FROM lineitem")
def _(t):
    return _six(stats.t_test_one(t("lineitem"), "l_quantity", 25))


@query("t_test_paired", "SELECT count(*) AS n, round(avg(l_tax - l_discount), 6) AS mean, round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 6) AS statistic, count(*) - 1.0 AS df FROM lineitem")
def _(t):
    return _six(stats.t_test_paired(t("lineitem"), "l_tax", "l_discount"))


_AB = "SELECT avg(l_extendedprice) FILTER (l_returnflag = 'A') m0, avg(l_extendedprice) FILTER (l_returnflag = 'R') m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') v0, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') v1, count(*) FILTER (l_returnflag = 'A') n0, count(*) FILTER (l_returnflag = 'R') n1 FROM lineitem"


@query("t_test_welch", f"WITH s AS ({_AB}) SELECT round(m0, 6) AS mean_a, round(m1, 6) AS mean_b, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS statistic, round((v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)), 4) AS df FROM s")
def _(t):
    return _six(stats.t_test_two(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R")).withColumn("df", F.round("df", 4))


@query("t_test_pooled", f"WITH s AS ({_AB}) SELECT round(m0, 6) AS mean_a, round(m1, 6) AS mean_b, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS statistic, (n0 + n1 - 2)::DOUBLE AS df FROM s")
def _(t):
    return _six(stats.t_test_two(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R", True))


@query("variance_test", f"WITH s AS ({_AB}) SELECT round(v0 / v1, 6) AS statistic, n0 - 1 AS df1, n1 - 1 AS df2 FROM s")
def _(t):
    return _six(stats.variance_test(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R"))


_G = "SELECT c_mktsegment g, count(*) n, avg(c_acctbal) m, var_samp(c_acctbal) v FROM customer GROUP BY 1"


@query("anova", f"WITH g AS ({_G}), a AS (SELECT sum(n * (m - (SELECT avg(c_acctbal) FROM customer)) ** 2) b, sum((n - 1) * v) w, count(*) k, sum(n) n FROM g) SELECT round(w, 2) AS ss_within, (k - 1)::DOUBLE AS df_between, (n - k)::DOUBLE AS df_within, round((b / (k - 1)) / (w / (n - k)), 6) AS statistic, round(b / (b + w), 6) AS eta_squared FROM a")
def _(t):
    return _six(stats.anova(t("customer"), "c_acctbal", "c_mktsegment"), "ss_between").withColumn("ss_within", F.round("ss_within", 2))


@query("welch_anova", f"WITH g AS (SELECT *, n / v AS w FROM ({_G})), t AS (SELECT sum(w) sw, sum(w * m) / sum(w) mw, count(*) k FROM g), a AS (SELECT max(k) k, sum(w * (m - mw) ** 2) / (max(k) - 1) num, sum((1 - w / sw) ** 2 / (n - 1)) c FROM g, t) SELECT round(num / (1 + 2 * (k - 2) / (k * k - 1) * c), 6) AS statistic, (k - 1)::DOUBLE AS df1, round((k * k - 1) / (3 * c), 4) AS df2 FROM a")
def _(t):
    return _six(stats.welch_anova(t("customer"), "c_acctbal", "c_mktsegment")).withColumn("df2", F.round("df2", 4))


@query("bartlett", f"WITH s AS (SELECT count(*) k, sum(n - 1) d, sum((n - 1) * v) / sum(n - 1) p, sum((n - 1) * ln(v)) l, sum(1.0 / (n - 1)) r FROM ({_G})) SELECT round((d * ln(p) - l) / (1 + (r - 1.0 / d) / (3 * (k - 1))), 6) AS statistic, (k - 1)::DOUBLE AS df FROM s")
def _(t):
    return _six(stats.bartlett(t("customer"), "c_acctbal", "c_mktsegment"))


@query("levene", "WITH z AS (SELECT c_mktsegment g, abs(c_acctbal - m) z FROM customer JOIN (SELECT c_mktsegment g, median(c_acctbal) m FROM customer GROUP BY 1) USING_ ON c_mktsegment = g), g AS (SELECT g, count(*) n, avg(z) m, var_samp(z) v FROM z GROUP BY 1), a AS (SELECT sum(n * (m - (SELECT avg(z) FROM z)) ** 2) b, sum((n - 1) * v) w, count(*) k, sum(n) n FROM g) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS statistic FROM a".replace("USING_", "c2").replace("c_mktsegment = g)", "c_mktsegment = c2.g)").replace("SELECT c_mktsegment g, abs", "SELECT c_mktsegment AS g, abs"))
def _(t):
    return _six(stats.levene(t("customer"), "c_acctbal", "c_mktsegment").select("statistic"))


_RANKS = "SELECT {g} g, {x} x, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 r, count(*) OVER (PARTITION BY {x}) c FROM {t}"


@query("kruskal", f"WITH r AS ({_RANKS.format(g='o_orderpriority', x='o_totalprice', t='orders')}), b AS (SELECT g, count(*) n, sum(r) s FROM r GROUP BY 1), a AS (SELECT count(*) k, sum(n)::DOUBLE n, sum(s * s / n) q, (SELECT sum(c * c - 1.0) FROM r) ties FROM b) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) AS statistic, (k - 1)::DOUBLE AS df FROM a")
def _(t):
    return _six(stats.kruskal(t("orders"), "o_totalprice", "o_orderpriority")).withColumn("statistic", F.round("statistic", 4))


@query("mann_whitney", f"WITH r AS ({_RANKS.format(g='l_returnflag', x='l_quantity', t='lineitem').replace('FROM lineitem', chr(70) + 'ROM lineitem WHERE l_returnflag IN (' + chr(39) + 'A' + chr(39) + ', ' + chr(39) + 'R' + chr(39) + ')')}) SELECT round(sum(r) FILTER (g = 'A') - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2.0, 4) AS statistic FROM r")
def _(t):
    return stats.mann_whitney(t("lineitem"), "l_quantity", "l_returnflag", "A", "R").select(F.round("statistic", 4).alias("statistic"))


@query("signed_rank", "WITH d AS (SELECT l_tax - l_discount d FROM lineitem WHERE l_tax - l_discount <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 r FROM d) SELECT round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 2) AS statistic FROM r")
def _(t):
    return stats.signed_rank(t("lineitem"), "l_tax", "l_discount").select(F.round("statistic", 2).alias("statistic"))


@query("friedman", "WITH x AS (SELECT l_returnflag t, l_suppkey b, avg(l_quantity) x FROM lineitem GROUP BY 1, 2), f AS (SELECT b FROM x GROUP BY 1 HAVING count(*) = 3), r AS (SELECT t, rank() OVER (PARTITION BY x.b ORDER BY x) + (count(*) OVER (PARTITION BY x.b, x) - 1) / 2.0 r, count(*) OVER (PARTITION BY x.b, x) c FROM x JOIN f ON x.b = f.b), s AS (SELECT t, sum(r) s, count(*) n FROM r GROUP BY 1), a AS (SELECT count(*)::DOUBLE k, max(n)::DOUBLE n, sum(s * s) q, (SELECT sum(c * c - 1.0) FROM r) ties FROM s) SELECT round((12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - ties / (n * (k ** 3 - k))), 6) AS statistic, k - 1 AS df FROM a")
def _(t):
    x = t("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("x"))
    whole = x.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n = 3").select("l_suppkey")
    return _six(stats.friedman(x.join(whole, "l_suppkey"), "x", "l_returnflag", "l_suppkey"))


@query("chisq_independence", "WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*) n FROM orders GROUP BY 1, 2), s AS (SELECT sum(n * n / (na * nb)::DOUBLE) q, sum(n) n, count(DISTINCT a) ka, count(DISTINCT b) kb FROM (SELECT *, sum(n) OVER (PARTITION BY a) na, sum(n) OVER (PARTITION BY b) nb FROM c)) SELECT round(n * (q - 1), 6) AS statistic, ((ka - 1) * (kb - 1))::DOUBLE AS df, round(sqrt(n * (q - 1) / (n * (least(ka, kb) - 1))), 6) AS cramers_v FROM s")
def _(t):
    return _six(stats.chisq_independence(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("chisq_fit", "SELECT round(sum((n - e) ** 2 / e), 6) AS statistic, count(*) - 1.0 AS df FROM (SELECT count(*) n, sum(count(*)) OVER () / (count(*) OVER ()) e FROM orders GROUP BY o_orderpriority)")
def _(t):
    return _six(stats.chisq_fit(t("orders"), "o_orderpriority"))


@query("ks_two", "WITH s AS (SELECT l_extendedprice x, sum((l_returnflag = 'A')::INT) a, sum((l_returnflag = 'R')::INT) b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () fb FROM s) SELECT round(max(abs(fa - fb)), 8) AS statistic FROM c")
def _(t):
    return stats.ks_two(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R").select(F.round("statistic", 8).alias("statistic"))


@query("proportions", "WITH s AS (SELECT avg((l_discount > 0.05)::INT) FILTER (l_returnflag = 'A') a, avg((l_discount > 0.05)::INT) FILTER (l_returnflag = 'R') b, count(*) FILTER (l_returnflag = 'A') n, count(*) FILTER (l_returnflag = 'R') m FROM lineitem) SELECT round(a, 6) AS share_a, round(b, 6) AS share_b, round((a - b) / sqrt((n * a + m * b) / (n + m) * (1 - (n * a + m * b) / (n + m)) * (1.0 / n + 1.0 / m)), 6) AS statistic FROM s")
def _(t):
    return _six(stats.proportions(t("lineitem"), F.col("l_discount") > 0.05, "l_returnflag", "A", "R"))


@query("correlation_test", "WITH s AS (SELECT corr(l_quantity, l_extendedprice) r, count(*) n FROM lineitem) SELECT round(r, 6) AS correlation, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS statistic, n - 2.0 AS df FROM s")
def _(t):
    return _six(stats.correlation_test(t("lineitem"), "l_quantity", "l_extendedprice")).withColumn("statistic", F.round("statistic", 4))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 b FROM lineitem) SELECT round(corr(a, b), 6) AS correlation FROM r")
def _(t):
    return stats.correlation_test(t("lineitem"), "l_quantity", "l_extendedprice", "spearman").select(F.round("correlation", 6).alias("correlation"))


@query("mcnemar", "SELECT round((abs(x - y) - 1) ** 2 / (x + y), 6) AS statistic FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) x, count(*) FILTER (quality = 0 AND toxic = 1) y FROM labels)")
def _(t):
    return _six(stats.mcnemar(t("labels"), "quality", "toxic"))


@query("confusion_matrix", "WITH s AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) tp, count(*) FILTER (toxic <> 1 AND quality = 1) fp, count(*) FILTER (toxic = 1 AND quality <> 1) fn, count(*) FILTER (toxic <> 1 AND quality <> 1) tn FROM labels) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity FROM s")
def _(t):
    return _six(stats.confusion(t("labels"), "toxic", "quality"), "mcc", "kappa")


@query("roc_auc", "WITH r AS (SELECT toxic y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 r FROM labels JOIN documents USING (doc_id)) SELECT round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM r")
def _(t):
    return rounded(stats.roc_auc(t("labels").join(t("documents"), "doc_id"), "toxic", "n_chars"), 8)


def _fit(fit, spark, digits=6, columns=("term", "estimate", "std_error")):
    return rounded(fit.frame(spark).select(*columns), digits)


@query("ols", "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, regr_sxx(l_extendedprice, l_quantity) sxx, regr_syy(l_extendedprice, l_quantity) syy, avg(l_quantity) m, count(*) n FROM lineitem), e AS (SELECT *, (syy - b * b * sxx) / (n - 2) s2 FROM s) SELECT '(Intercept)' AS term, round(a, 4) AS estimate, round(sqrt(s2 * (1.0 / n + m * m / sxx)), 4) AS std_error FROM e UNION ALL SELECT 'l_quantity', round(b, 4), round(sqrt(s2 / sxx), 4) FROM e")
def _(t):
    li = t("lineitem")
    return _fit(moments.ols(li, "l_extendedprice", ["l_quantity"]), li.sparkSession, 4)


@query("ols_hc1", "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, regr_sxx(l_extendedprice, l_quantity) sxx, avg(l_quantity) m, count(*) n FROM lineitem), v AS (SELECT sum((l_extendedprice - a - b * l_quantity) ** 2 * (l_quantity - m) ** 2) / max(sxx) ** 2 * max(n) / (max(n) - 2) v FROM lineitem, s) SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(sqrt(v), 4) AS std_error FROM s, v")
def _(t):
    li = t("lineitem")
    return _fit(moments.ols(li, "l_extendedprice", ["l_quantity"], "HC1"), li.sparkSession, 4).where("term = 'l_quantity'")


@query("ols_multiple")
def _(t):
    li = t("lineitem")
    return moments.ols(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "HC3").frame(li.sparkSession)


@query("ols_clustered")
def _(t):
    li = t("lineitem")
    return moments.ols(li, "l_extendedprice", ["l_quantity", "l_discount"], cluster="l_suppkey").frame(li.sparkSession)


@query("wls", "WITH s AS (SELECT sum(l_quantity) w, sum(l_quantity * l_discount) / sum(l_quantity) mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) my FROM lineitem) SELECT 'l_discount' AS term, round(sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_discount - mx) ** 2), 2) AS estimate FROM lineitem, s")
def _(t):
    li = t("lineitem")
    return _fit(moments.ols(li, "l_extendedprice", ["l_discount"], weight="l_quantity"), li.sparkSession, 2, ("term", "estimate")).where("term = 'l_discount'")


@query("ridge")
def _(t):
    li = t("lineitem")
    return moments.ridge(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 0.1).frame(li.sparkSession)


for _family in ("logit", "probit", "poisson"):

    @query(_family)
    def _(t, family=_family):
        rows = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 10).alias("q"), "l_discount")
        return moments.glm(rows, "y", ["q", "l_discount"], family).frame(rows.sparkSession)


@query("fixed_effects", "WITH d AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) x, l_suppkey FROM lineitem), s AS (SELECT sum(x * y) / sum(x * x) b, sum(x * x) sxx, sum(y * y) syy, count(*) - count(DISTINCT l_suppkey) - 1 df FROM d) SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(sqrt((syy - b * b * sxx) / df / sxx), 4) AS std_error FROM s")
def _(t):
    li = t("lineitem")
    return _fit(moments.fixed_effects(li, "l_extendedprice", ["l_quantity"], "l_suppkey"), li.sparkSession, 4)


@query("random_effects")
def _(t):
    li = t("lineitem")
    return moments.random_effects(li, "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey").frame(li.sparkSession)


@query("iv_2sls", "SELECT 'l_quantity' AS term, round(covar_samp(l_extendedprice, z) / covar_samp(l_quantity, z), 4) AS estimate FROM (SELECT *, l_quantity + l_linenumber AS z FROM lineitem)")
def _(t):
    li = t("lineitem").withColumn("z", F.col("l_quantity") + F.col("l_linenumber"))
    return _fit(moments.iv_2sls(li, "l_extendedprice", [], ["l_quantity"], ["z"]), li.sparkSession, 4, ("term", "estimate")).where("term = 'l_quantity'")


_DID = "SELECT l_extendedprice y, (l_returnflag = 'R')::INT treated, (l_shipdate >= TIMESTAMP '1996-01-01')::INT post FROM lineitem"


@query("did", f"SELECT round((avg(y) FILTER (treated = 1 AND post = 1) - avg(y) FILTER (treated = 1 AND post = 0)) - (avg(y) FILTER (treated = 0 AND post = 1) - avg(y) FILTER (treated = 0 AND post = 0)), 4) AS att FROM ({_DID})")
def _(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("treated"), (F.col("l_shipdate") >= F.expr("timestamp_ntz'1996-01-01'")).cast("int").alias("post"))
    return causal.did(rows, "y", "treated", "post").select(F.round("att", 4).alias("att"))


@query("event_study", "WITH c AS (SELECT year(l_shipdate) p, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') d FROM lineitem GROUP BY 1) SELECT p AS period, round(d - (SELECT d FROM c WHERE p = 1996), 6) AS effect FROM c WHERE d IS NOT NULL")
def _(t):
    rows = t("lineitem").select("l_quantity", F.year("l_shipdate").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("r"))
    return rounded(causal.event_study(rows, "l_quantity", "r", "p", 1996), 6)


for _estimand in ("ate", "att"):

    @query(f"ipw_{_estimand}")
    def _(t, estimand=_estimand):
        rows = t("lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("r"), "l_discount", "l_tax")
        return causal.ipw(rows, "l_extendedprice", "r", ["l_discount", "l_tax"], estimand)


@query("aipw")
def _(t):
    rows = t("lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("r"), "l_discount", "l_quantity")
    return causal.aipw(rows, "l_extendedprice", "r", ["l_discount", "l_quantity"])


@query("regression_discontinuity", "WITH k AS (SELECT l_extendedprice y, l_quantity - 25 x, 1 - abs(l_quantity - 25) / 10 w FROM lineitem WHERE abs(l_quantity - 25) < 10), f AS (SELECT x >= 0 s, sum(w) w, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy FROM k GROUP BY 1) SELECT round(max((sxx * sy - sx * sxy) / (w * sxx - sx * sx)) FILTER (s) - max((sxx * sy - sx * sxy) / (w * sxx - sx * sx)) FILTER (NOT s), 4) AS effect FROM f")
def _(t):
    return causal.rd_local_linear(t("lineitem"), "l_extendedprice", "l_quantity", 25, 10).select(F.round("effect", 4).alias("effect"))


@query("acf", "WITH s AS (SELECT value - avg(value) OVER () x, event_id FROM events), l AS (SELECT x, lag(x, 1) OVER (ORDER BY event_id) a, lag(x, 2) OVER (ORDER BY event_id) b, lag(x, 3) OVER (ORDER BY event_id) c FROM s) SELECT unnest([0, 1, 2, 3]) AS lag, unnest([1.0, round(sum(x * a) / sum(x * x), 8), round(sum(x * b) / sum(x * x), 8), round(sum(x * c) / sum(x * x), 8)]) AS acf FROM l")
def _(t):
    return rounded(series.acf(t("events"), "value", ["event_id"], 3), 8)


@query("pacf")
def _(t):
    e = t("events")
    return e.sparkSession.createDataFrame(list(enumerate(series.pacf(e, "value", ["event_id"], 5), 1)), "lag int, pacf double")


@query("ljung_box")
def _(t):
    return series.ljung_box(t("events"), "value", ["event_id"], 5)


@query("durbin_watson", "SELECT round(sum((x - p) ** 2) / sum(x * x), 8) AS statistic FROM (SELECT value x, lag(value) OVER (ORDER BY event_id) p FROM events)")
def _(t):
    return rounded(series.durbin_watson(t("events"), "value", ["event_id"]), 8)


@query("moving_average", "SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING), 6) AS moving FROM events")
def _(t):
    return rounded(series.moving(t("events").select("event_id", "value"), "value", ["event_id"], 4, 2).drop("value"), 6)


@query("running_median", "SELECT event_id, median(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS moving FROM events")
def _(t):
    return series.moving(t("events").select("event_id", "value"), "value", ["event_id"], 3, 3, "median").drop("value")


@query("decompose")
def _(t):
    return series.decompose(t("events").select("event_id", "value"), "value", ["event_id"], 12)


_LIFE = "SELECT l_quantity AS t, (l_returnflag = 'R')::INT AS e, l_linestatus AS g FROM lineitem"


@query("kaplan_meier", f"WITH b AS (SELECT t, sum(e) d, count(*) n FROM ({_LIFE}) GROUP BY 1), r AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) r FROM b), s AS (SELECT *, exp(sum(ln(CASE WHEN d < r THEN 1 - d / r END)) OVER (ORDER BY t)) s, sum(CASE WHEN d < r THEN d / (r * (r - d)) END) OVER (ORDER BY t) v, sum(d / r) OVER (ORDER BY t) h, max((d >= r)::INT) OVER (ORDER BY t) z FROM r) SELECT t AS time, r AS n_risk, d AS n_event, round(CASE WHEN z = 1 THEN 0 ELSE s END, 6) AS survival, round(CASE WHEN z = 1 THEN 0 ELSE s END * sqrt(v), 6) AS std_error, round(h, 6) AS hazard FROM s")
def _(t):
    rows = t("lineitem").select(F.col("l_quantity").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"))
    return rounded(survival.kaplan_meier(rows, "t", "e").drop("low", "high"), 6)


@query("log_rank", f"WITH b AS (SELECT t, sum(e) d, count(*) n, sum(e * (g = 'F')::INT) da, sum((g = 'F')::INT) na FROM ({_LIFE}) GROUP BY 1), r AS (SELECT n, na, d, da, sum(n) OVER (ORDER BY t DESC) r, sum(na) OVER (ORDER BY t DESC) ra FROM b), s AS (SELECT sum(na) na, sum(n) n, sum(da) o, sum(d) d, sum(d * ra / r) e, sum(CASE WHEN r > 1 THEN d * (ra / r) * (1 - ra / r) * (r - d) / (r - 1) ELSE 0 END) v FROM r), f AS (SELECT *, round((o - e) ** 2 / v, 6) AS statistic FROM s) SELECT 'F' AS group, na AS n, o AS observed, round(e, 6) AS expected, statistic, 1 AS df FROM f UNION ALL SELECT 'O', n - na, d - o, round(d - e, 6), statistic, 1 FROM f")
def _(t):
    rows = t("lineitem").select(F.col("l_quantity").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"), F.col("l_linestatus").alias("g"))
    return _six(survival.log_rank(rows, "t", "e", "g"))


@query("kmeans")
def _(t):
    return learn.kmeans(t("embeddings"), "embedding", "vec_id", 5)


@query("pca")
def _(t):
    return learn.pca(t("embeddings"), "embedding", 3)


@query("association_rules")
def _(t):
    baskets = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))
    return learn.association_rules(baskets, "items", 0.001, 0.05)


@query("norms_by_label", "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM embeddings GROUP BY 1")
def _(t):
    return rounded(learn.norms_by(t("embeddings"), "embedding", "label"), 6)


def _row(spark, names, values):
    return spark.createDataFrame([tuple(float(v) for v in values)], ", ".join(f"{n} double" for n in names))


@query("histogram", "WITH s AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer) SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 8)), 7)::INT AS bin, count(*) AS n FROM customer, s GROUP BY 1")
def _(t):
    return models.histogram(t("customer"), "c_acctbal", 8).select("bin", "n")


@query("ecdf", "SELECT p_size AS value, round(sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER (), 8) AS share FROM part GROUP BY 1")
def _(t):
    return rounded(models.ecdf(t("part"), "p_size"), 8)


@query("mean_group", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return rounded(models.mean_group(t("lineitem"), "l_extendedprice", "l_quantity", "l_suppkey").drop("intercept"), 4)


@query("first_difference", "WITH d AS (SELECT value - lag(value) OVER w y, x - lag(x) OVER w x FROM (SELECT user_id, event_id, value, event_id % 97 AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 8) AS estimate FROM d")
def _(t):
    e = t("events").select("user_id", "event_id", "value", (F.col("event_id") % 97).alias("x"))
    return rounded(models.first_difference(e, "value", ["x"], "user_id", ["event_id"]).frame(e.sparkSession).select("term", "estimate"), 8)


@query("staggered_att", "WITH r AS (SELECT l_suppkey u, year(l_shipdate) t, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 1994 + l_suppkey % 3 END g, avg(l_quantity) y FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT g, t, avg(y) m, count(*) n FROM r GROUP BY 1, 2) SELECT a.g, a.t, round((a.m - b.m) - (c.m - d.m), 6) AS att, a.n FROM m a JOIN m b ON a.g = b.g AND b.t = a.g - 1 JOIN m c ON c.g IS NULL AND c.t = a.t JOIN m d ON d.g IS NULL AND d.t = a.g - 1")
def _(t):
    g = F.when(F.col("l_suppkey") % 3 != 0, (1994 + F.col("l_suppkey") % 3).cast("int"))
    rows = t("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("t"), g.alias("g")).agg(F.avg("l_quantity").alias("y"))
    return rounded(models.att_gt(rows, "y", "l_suppkey", "t", "g"), 6)


@query("vif", "WITH s AS (SELECT corr(l_quantity, l_discount) r FROM lineitem) SELECT unnest(['l_quantity', 'l_discount']) AS term, round(1 / (1 - r * r), 8) AS vif FROM s")
def _(t):
    return rounded(models.vif(t("lineitem"), ["l_quantity", "l_discount"]), 8)


@query("elastic_net")
def _(t):
    return models.elastic_net(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], [1.0, 10.0, 100.0], 0.5)


@query("lasso", "WITH s AS (SELECT corr(l_extendedprice, l_quantity) r, stddev_pop(l_extendedprice) sy, stddev_pop(l_quantity) sx FROM lineitem) SELECT 100.0::DOUBLE AS penalty, 'l_quantity' AS term, round(sign(r) * greatest(abs(r) - 100 / sy, 0) * sy / sx, 4) AS estimate FROM s")
def _(t):
    return rounded(models.elastic_net(t("lineitem"), "l_extendedprice", ["l_quantity"], [100.0]).where("term = 'l_quantity'"), 4)


@query("hdfe")
def _(t):
    li = t("lineitem").withColumn("year", F.year("l_shipdate"))
    return models.hdfe(li, "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey", "year"]).frame(li.sparkSession)


@query("quantile_regression")
def _(t):
    li = t("lineitem")
    return models.quantile_regression(li, "l_extendedprice", ["l_quantity"], 0.5).frame(li.sparkSession).select("term", "estimate")


@query("breusch_pagan")
def _(t):
    li = t("lineitem")
    return _row(li.sparkSession, ("statistic", "df", "p_value"), models.breusch_pagan(li, "l_extendedprice", ["l_quantity", "l_discount"]))


@query("reset_test")
def _(t):
    li = t("lineitem")
    return _row(li.sparkSession, ("statistic", "df1", "df2", "p_value"), models.reset(li, "l_extendedprice", ["l_quantity", "l_discount"]))


@query("iv_first_stage")
def _(t):
    li = t("lineitem").withColumn("z", F.col("l_quantity") + F.col("l_linenumber"))
    return _row(li.sparkSession, ("statistic", "p_value"), models.first_stage(li, "l_quantity", ["z"], ["l_tax"]))


@query("iv_sargan")
def _(t):
    li = t("lineitem").withColumn("z", F.col("l_quantity") + F.col("l_linenumber"))
    return _row(li.sparkSession, ("statistic", "df", "p_value"), models.sargan(li, "l_extendedprice", [], ["l_quantity"], ["z", "l_tax"]))


@query("cox")
def _(t):
    rows = t("lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("e"), "l_discount", "l_tax")
    return models.cox(rows, "l_quantity", "e", ["l_discount", "l_tax"]).frame(rows.sparkSession)


@query("competing_risks")
def _(t):
    rows = t("lineitem").select("l_quantity", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("cause"))
    return models.cumulative_incidence(rows, "l_quantity", "cause")


@query("granger")
def _(t):
    e = t("events").select("event_id", "value", (F.col("event_id") % 13).cast("double").alias("x"))
    return _row(e.sparkSession, ("statistic", "df", "p_value"), models.granger(e, "x", "value", ["event_id"], 2))


@query("holt_winters")
def _(t):
    days = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return models.holt_winters(days, "v", ["day"], ["event_type"], 7, 3)


@query("anova_two_way", "WITH r AS (SELECT o_orderstatus a, o_orderpriority b, o_totalprice y FROM orders), g AS (SELECT avg(y) m FROM r), a AS (SELECT sum(n * (c.m - g.m) ** 2) s FROM (SELECT a, avg(y) m, count(*) n FROM r GROUP BY 1) c, g) SELECT 'a' AS source, round(s, 0) AS ss FROM a")
def _(t):
    return models.two_way_anova(t("orders"), "o_totalprice", "o_orderstatus", "o_orderpriority").where("source = 'a'").select("source", F.round("ss", 0).alias("ss"))


@query("moran")
def _(t):
    c = t("customer").select("c_custkey", (F.col("c_custkey") % 40).alias("x"), F.floor(F.col("c_custkey") / 40).alias("y"), "c_acctbal")
    return models.moran(c, "c_custkey", "x", "y", "c_acctbal", 1.5)


@query("generate")
def _(t):
    return models.generate(t("region").sparkSession, 1000, {"a": ("normal", 0, 1), "b": ("integer", 1, 6), "c": ("choice", ["x", "y"])}, 3)


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming import events

    rows = events.windowed(t("events"), "ts", ["event_type"], "value")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
