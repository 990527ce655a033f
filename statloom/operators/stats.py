"""Descriptive statistics and hypothesis tests as aggregates.

Every test is a frame of one or a few rows: statistic, degrees of freedom and
p-value. Nulls and NaN are left out. Counts, sums and ranks are grouped on the
executors; only the p-value of the final rows needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import p_value, t_limit
from .ranks import average_ranks, value_ranks


def _x(column: str) -> Column:
    c = F.col(column).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def _groups(df: DataFrame, value: str, group: str) -> DataFrame:
    rows = df.select(F.col(group).alias("g"), _x(value).alias("x")).where("g is not null and x is not null")
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std, skewness, kurtosis (excess) and the Jarque-Bera test of one column."""
    x = _x(column)
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    return s.withColumn("jarque_bera", jb).withColumn("p_value", p_value("chi2", F.col("jarque_bera"), F.lit(2)))


def robust(df: DataFrame, column: str, trim: float = 0.1) -> DataFrame:
    """Median, MAD (scaled), IQR, trimmed and winsorised mean; three passes, no collected rows."""
    x = _x(column)
    rows = df.select(x.alias("x")).where("x is not null")
    n, q = rows.agg(F.count("*"), F.percentile("x", [0.25, 0.5, 0.75])).first()
    if not n:
        return df.sparkSession.createDataFrame([], "n long, median double, mad double, iqr double, trimmed_mean double, winsorized_mean double")
    k = int(n * trim)
    ranks = value_ranks(rows, "x")
    # rows of a value that stay after k are cut at either end
    kept = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), F.lit(n - k)) - F.greatest(F.col("below"), F.lit(k)))
    low = F.min(F.when(kept > 0, F.col("x")))
    high = F.max(F.when(kept > 0, F.col("x")))
    t = ranks.agg(F.sum(kept * F.col("x")).alias("s"), F.sum(kept).alias("c"), low.alias("lo"), high.alias("hi"))
    mad = rows.agg(F.percentile(F.abs(F.col("x") - q[1]), 0.5).alias("m"))
    return t.crossJoin(mad).select(F.lit(n).alias("n"), F.lit(q[1]).alias("median"), (F.col("m") * 1.4826).alias("mad"), F.lit(q[2] - q[0]).alias("iqr"), (F.col("s") / F.col("c")).alias("trimmed_mean"), ((F.col("s") + k * (F.col("lo") + F.col("hi"))) / n).alias("winsorized_mean"))  # one row each


#: What a test may look for.
ALTERNATIVES = ("two-sided", "greater", "less")


def _side(two_sided: Column, statistic: Column, alternative: str) -> Column:
    """The p-value on the side looked for, of a statistic that is symmetric around zero."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"the alternative is one of {', '.join(ALTERNATIVES)}")
    if alternative == "two-sided":
        return two_sided
    return F.when((statistic > 0) == F.lit(alternative == "greater"), two_sided / 2).otherwise(1 - two_sided / 2)


def _t_told(s: DataFrame, estimate: Column, se: Column, alternative: str, level: float | None, keep: list[str]) -> DataFrame:
    """p-value and, with a level, confidence limits (one-sided ones for a one-sided alternative) of rows with statistic and df."""
    s = s.withColumn("__p", p_value("t", F.col("statistic"), F.col("df")))
    limits = []
    if level is not None:
        one = alternative != "two-sided"
        s = s.withColumn("__c", t_limit(F.col("df"), 2 * level - 1 if one else level))
        low, high = estimate - F.col("__c") * se, estimate + F.col("__c") * se
        limits = [(F.lit(float("-inf")) if alternative == "less" else low).alias("low"), (F.lit(float("inf")) if alternative == "greater" else high).alias("high")]
    return s.select(*keep, "statistic", "df", _side(F.col("__p"), F.col("statistic"), alternative).alias("p_value"), *limits)


def t_test_one(df: DataFrame, column: str, mu: float = 0.0, alternative: str = "two-sided", level: float | None = None) -> DataFrame:
    """Test of a mean against ``mu``; with a ``level`` also its confidence limits (low, high)."""
    x = _x(column)
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("__se"))
    s = s.withColumn("statistic", (F.col("mean") - mu) / F.col("__se")).withColumn("df", (F.col("n") - 1).cast("double"))
    return _t_told(s, F.col("mean"), F.col("__se"), alternative, level, ["n", "mean"])


def t_test_paired(df: DataFrame, a: str, b: str, mu: float = 0.0, alternative: str = "two-sided", level: float | None = None) -> DataFrame:
    """Test of the mean of a - b against ``mu``."""
    return t_test_one(df.select((_x(a) - _x(b)).alias("d")), "d", mu, alternative, level)


def _two(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    x = _x(value)
    cols = []
    for i, g in enumerate((a, b)):
        v = F.when(F.col(group) == F.lit(g), x)
        cols += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
    return df.agg(*cols)


def t_test_two(df: DataFrame, value: str, group: str, a, b, equal_variance: bool = False, mu: float = 0.0, alternative: str = "two-sided", level: float | None = None) -> DataFrame:
    """Welch's test, or the pooled one, of the mean of a less that of b against ``mu``."""
    s = _two(df, value, group, a, b)
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "v0", "v1"))
    if equal_variance:
        pooled = ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)
        se, dof = F.sqrt(pooled * (1 / n0 + 1 / n1)), (n0 + n1 - 2).cast("double")
    else:
        a_, b_ = v0 / n0, v1 / n1
        se, dof = F.sqrt(a_ + b_), (a_ + b_) ** 2 / (a_ * a_ / (n0 - 1) + b_ * b_ / (n1 - 1))
    apart = F.col("m0") - F.col("m1")
    s = s.select(F.col("m0").alias("mean_a"), F.col("m1").alias("mean_b"), apart.alias("__d"), se.alias("__se"), ((apart - mu) / se).alias("statistic"), dof.alias("df"))
    return _t_told(s, F.col("__d"), F.col("__se"), alternative, level, ["mean_a", "mean_b"])


def variance_test(df: DataFrame, value: str, group: str, a, b, ratio: float = 1.0, alternative: str = "two-sided") -> DataFrame:
    """F test of the ratio of two variances against ``ratio``."""
    s = _two(df, value, group, a, b).select((F.col("v0") / F.col("v1") / ratio).alias("statistic"), (F.col("n0") - 1).alias("df1"), (F.col("n1") - 1).alias("df2"))
    upper = F.col("__u")
    sides = {"two-sided": 2 * F.least(upper, 1 - upper), "greater": upper, "less": 1 - upper}
    if alternative not in sides:
        raise ValueError(f"the alternative is one of {', '.join(ALTERNATIVES)}")
    return s.withColumn("__u", p_value("f", F.col("statistic"), F.col("df1"), F.col("df2"))).withColumn("p_value", sides[alternative]).drop("__u")


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance with eta squared."""
    g = _groups(df, value, group)
    g = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"))
    g = g.withColumn("ss_between", F.col("q") - F.col("s") ** 2 / F.col("n")).withColumn("df_between", (F.col("k") - 1).cast("double")).withColumn("df_within", (F.col("n") - F.col("k")).cast("double"))
    g = g.select("ss_between", "ss_within", "df_between", "df_within", ((F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within"))).alias("statistic"), (F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))).alias("eta_squared"))
    return g.withColumn("p_value", p_value("f", F.col("statistic"), F.col("df_between"), F.col("df_within")))


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    g = _groups(df, value, group).withColumn("w", F.col("n") / F.col("v"))
    t = g.agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mw"), F.count("*").alias("k"))
    j = g.crossJoin(t)  # one row
    a = j.agg(F.first("k").alias("k"), (F.sum(F.col("w") * (F.col("m") - F.col("mw")) ** 2) / (F.first("k") - 1)).alias("num"), F.sum((1 - F.col("w") / F.col("sw")) ** 2 / (F.col("n") - 1)).alias("c"))
    k = F.col("k")
    a = a.select((F.col("num") / (1 + 2 * (k - 2) / (k * k - 1) * F.col("c"))).alias("statistic"), (k - 1).cast("double").alias("df1"), ((k * k - 1) / (3 * F.col("c"))).alias("df2"))
    return a.withColumn("p_value", p_value("f", F.col("statistic"), F.col("df1"), F.col("df2")))


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    g = _groups(df, value, group).withColumn("d", F.col("n") - 1)
    s = g.agg(F.count("*").alias("k"), F.sum("d").alias("d"), (F.sum(F.col("d") * F.col("v")) / F.sum("d")).alias("p"), F.sum(F.col("d") * F.ln("v")).alias("l"), F.sum(1 / F.col("d")).alias("r"))
    stat = (F.col("d") * F.ln("p") - F.col("l")) / (1 + (F.col("r") - 1 / F.col("d")) / (3 * (F.col("k") - 1)))
    return s.select(stat.alias("statistic"), (F.col("k") - 1).cast("double").alias("df")).withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def levene(df: DataFrame, value: str, group: str, center: str = "median") -> DataFrame:
    """Levene's test; around the median it is Brown and Forsythe's."""
    rows = df.select(F.col(group).alias("g"), _x(value).alias("x")).where("g is not null and x is not null")
    mid = rows.groupBy("g").agg((F.median if center == "median" else F.avg)("x").alias("c"))
    return anova(rows.join(mid, "g").select("g", F.abs(F.col("x") - F.col("c")).alias("z")), "z", "g")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis with the correction for ties, from counts per value and group: rows are never joined to their ranks."""
    rows = df.select(F.col(group).alias("g"), _x(value).alias("x")).where("g is not null and x is not null")
    cells = rows.groupBy("g", "x").agg(F.count("*").alias("c"))
    ranks = value_ranks(cells, "x", "c")
    by = cells.join(ranks, "x").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("below") + (F.col("n") + 1) / 2)).alias("s"))
    t = by.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") ** 2 / F.col("n")).alias("q"))
    ties = ranks.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    out = t.crossJoin(ties).select(h.alias("statistic"), (F.col("k") - 1).cast("double").alias("df"))  # one row each
    return out.withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def _towards(d: Column, continuity: bool, alternative: str) -> Column:
    """A half towards the middle, or against the side looked for."""
    half = F.signum(d) if alternative == "two-sided" else F.lit(1.0 if alternative == "greater" else -1.0)
    return d - half * (0.5 if continuity else 0.0)


def mann_whitney(df: DataFrame, value: str, group: str, a, b, continuity: bool = True, alternative: str = "two-sided") -> DataFrame:
    """Rank-sum test of two groups by the normal approximation, with ties."""
    rows = df.where(F.col(group).isin(a, b)).select((F.col(group) == F.lit(a)).cast("int").alias("a"), _x(value).alias("x")).where("x is not null")
    cells = rows.groupBy("x").agg(F.count("*").alias("c"), F.sum("a").alias("ca"))
    ranks = value_ranks(cells, "x", "c", "ca")
    s = ranks.agg(F.sum("ca").alias("na"), F.sum("n").alias("n"), F.sum(F.col("ca") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ra"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    s = s.withColumn("nb", F.col("n") - F.col("na")).withColumn("statistic", F.col("ra") - F.col("na") * (F.col("na") + 1) / 2)
    n, na, nb = F.col("n").cast("double"), F.col("na").cast("double"), F.col("nb").cast("double")
    d = F.col("statistic") - na * nb / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.select("statistic", (_towards(d, continuity, alternative) / sd).alias("z")).withColumn("p_value", p_value("z", F.col("z")))
    return s.withColumn("p_value", _side(F.col("p_value"), F.col("z"), alternative))


def signed_rank(df: DataFrame, a: str, b: str, mu: float = 0.0, continuity: bool = False, alternative: str = "two-sided") -> DataFrame:
    """Wilcoxon's signed-rank test of a - b against ``mu`` (zero differences left out), by the normal approximation."""
    rows = df.select((_x(a) - _x(b) - mu).alias("d")).where("d is not null and d <> 0").select("d", F.abs("d").alias("x"))
    ranked = average_ranks(rows, "x", "r")
    s = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("statistic"))
    ties = value_ranks(rows, "x").agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    z = _towards(F.col("statistic") - n * (n + 1) / 4, continuity, alternative) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    s = s.crossJoin(ties).select("statistic", z.alias("z")).withColumn("p_value", p_value("z", F.col("z")))  # one row each
    return s.withColumn("p_value", _side(F.col("p_value"), F.col("z"), alternative))


def friedman(df: DataFrame, value: str, treatment: str, block: str) -> DataFrame:
    """Friedman's test of a complete block design, ranks within blocks."""
    from pyspark.sql import Window

    w = Window.partitionBy("b")
    rows = df.select(F.col(block).alias("b"), F.col(treatment).alias("t"), _x(value).alias("x")).where("x is not null")
    same = Window.partitionBy("b", "x")
    rows = rows.withColumn("r", F.rank().over(w.orderBy("x")) + (F.count("*").over(same) - 1) / 2).withColumn("c", F.count("*").over(same))
    s = rows.groupBy("t").agg(F.sum("r").alias("s"), F.count("*").alias("n")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("s") ** 2).alias("q"))
    ties = rows.agg(F.sum(F.col("c") ** 2 - 1.0).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    stat = (12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * (k**3 - k)))
    out = s.crossJoin(ties).select(stat.alias("statistic"), (k - 1).alias("df"))  # one row each
    return out.withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def chisq_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's chi-squared of a cross table, without correction, and Cramer's V."""
    cells = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # sum((o - e)^2 / e) = N * (sum(o^2 / (row * column)) - 1): empty cells add nothing
    q = cells.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") ** 2 / (F.col("na").cast("double") * F.col("nb"))).alias("q"), F.sum("n").alias("n"))
    q = q.crossJoin(ra.agg(F.count("*").alias("ka"))).crossJoin(rb.agg(F.count("*").alias("kb")))  # one row each
    stat = F.col("n") * (F.col("q") - 1)
    q = q.select(stat.alias("statistic"), ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("double").alias("df"), F.sqrt(stat / (F.col("n") * (F.least("ka", "kb") - 1))).alias("cramers_v"))
    return q.withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def chisq_fit(df: DataFrame, column: str) -> DataFrame:
    """Goodness of fit to equal shares."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n").cast("double") ** 2).alias("q"))
    c = c.select((F.col("q") * F.col("k") / F.col("t") - F.col("t")).alias("statistic"), (F.col("k") - 1).cast("double").alias("df"))
    return c.withColumn("p_value", p_value("chi2", F.col("statistic"), F.col("df")))


def ks_two(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: distribution functions at every value by ranged prefix sums."""
    rows = df.where(F.col(group).isin(a, b)).select((F.col(group) == F.lit(a)).cast("int").alias("a"), _x(value).alias("x")).where("x is not null")
    from .ordering import ranged, running_all

    steps = rows.groupBy("x").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    steps = running_all(ranged(steps, ["x"]), {"ca": F.col("na"), "cb": F.col("nb")}, ["x"])
    t = rows.agg(F.sum("a").alias("ta"), F.sum(1 - F.col("a")).alias("tb"))
    d = steps.crossJoin(t).agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("statistic"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))  # one row
    n = F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb"))
    return d.select("statistic", n.alias("n_effective")).withColumn("p_value", p_value("ks", F.sqrt("n_effective") * F.col("statistic"))).drop("n_effective")


def proportions(df: DataFrame, success: Column, group: str, a, b) -> DataFrame:
    """Two-proportion z test."""
    hit = success.cast("int")
    cols = []
    for i, g in enumerate((a, b)):
        v = F.when(F.col(group) == F.lit(g), hit)
        cols += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"p{i}")]
    s = df.agg(*cols)
    n0, n1, p0, p1 = (F.col(c) for c in ("n0", "n1", "p0", "p1"))
    p = (n0 * p0 + n1 * p1) / (n0 + n1)
    s = s.select(p0.alias("share_a"), p1.alias("share_b"), ((p0 - p1) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))).alias("statistic"))
    return s.withColumn("p_value", p_value("z", F.col("statistic")))


def correlation_test(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    rows = df.select(_x(a).alias("a"), _x(b).alias("b")).where("a is not null and b is not null")
    if method == "spearman":
        rows = average_ranks(average_ranks(rows, "a", "a"), "b", "b")
    s = rows.agg(F.corr("a", "b").alias("correlation"), F.count("*").alias("n"))
    r = F.col("correlation")
    s = s.select("correlation", (r * F.sqrt((F.col("n") - 2) / (1 - r * r))).alias("statistic"), (F.col("n") - 2).cast("double").alias("df"))
    return s.withColumn("p_value", p_value("t", F.col("statistic"), F.col("df")))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """McNemar's test of two 0/1 columns, with the continuity correction."""
    s = df.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("x"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("y"))
    s = s.select(((F.abs(F.col("x") - F.col("y")) - 1) ** 2 / (F.col("x") + F.col("y"))).alias("statistic"))
    return s.withColumn("p_value", p_value("chi2", F.col("statistic"), F.lit(1)))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and scores of a 0/1 prediction: accuracy, precision, recall, f1, specificity, mcc, kappa."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    s = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    div = lambda a, b: F.when(b != 0, a / F.when(b != 0, b)).otherwise(0.0)
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    accuracy = (tp + tn) / n
    return s.select("tp", "fp", "fn", "tn", accuracy.alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tn, tn + fp).alias("specificity"), div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), ((accuracy - chance) / (1 - chance)).alias("kappa"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve by average ranks."""
    rows = df.select(F.col(truth).cast("int").alias("y"), _x(score).alias("x")).where("y is not null and x is not null")
    s = average_ranks(rows, "x", "r").agg(F.sum("y").alias("p"), F.count("*").alias("n"), F.sum(F.col("y") * F.col("r")).alias("s"))
    return s.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))
