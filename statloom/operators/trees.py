"""Trees and their ensembles, support vector machines and what explains them, on Spark's ML."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _data(df: DataFrame, x: list[str], y: str | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = df.withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(x)})
    if y:
        rows = rows.withColumn("__y", F.col(y).cast("double"))
    return VectorAssembler(inputCols=[f"__x{i}" for i in range(len(x))], outputCol="__features", handleInvalid="skip").transform(rows)


class Learner:
    """A fitted model with the columns it reads."""

    def __init__(self, model, x: list[str]) -> None:
        self.model, self.x = model, x

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """``df`` with the prediction (a class number or a value)."""
        return self.model.transform(_data(df, self.x)).withColumn(name, F.col("__predicted")).select(*df.columns, name)

    def probability(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """``df`` with the probability of class 1."""
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(_data(df, self.x)).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)

    def importance(self, spark) -> DataFrame:
        """Share of the impurity that each column removes."""
        return spark.createDataFrame([(c, float(v)) for c, v in zip(self.x, self.model.featureImportances.toArray(), strict=True)], "term string, importance double")

    def description(self) -> str:
        return self.model.toDebugString


def _fit(kind, df: DataFrame, y: str, x: list[str], **options) -> Learner:
    return Learner(kind(featuresCol="__features", labelCol="__y", predictionCol="__predicted", **options).fit(_data(df, x, y)), x)


def cart(df: DataFrame, y: str, x: list[str], classify: bool = True, depth: int = 5, least: int = 1, impurity: str | None = None) -> Learner:
    """One tree of binary splits: Gini or entropy for classes, variance for values."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import DecisionTreeRegressor

    more = {"impurity": impurity} if impurity else {}
    return _fit(DecisionTreeClassifier if classify else DecisionTreeRegressor, df, y, x, maxDepth=depth, minInstancesPerNode=least, seed=1, **more)


def random_forest(df: DataFrame, y: str, x: list[str], classify: bool = True, trees: int = 50, depth: int = 8, seed: int = 1, share: float = 1.0) -> Learner:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    return _fit(RandomForestClassifier if classify else RandomForestRegressor, df, y, x, numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=share)


def gradient_boosting(df: DataFrame, y: str, x: list[str], classify: bool = True, rounds: int = 30, depth: int = 3, rate: float = 0.1, seed: int = 1, share: float = 1.0) -> Learner:
    """Boosted trees (classes 0 and 1, or values)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    return _fit(GBTClassifier if classify else GBTRegressor, df, y, x, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=share)


def linear_svm(df: DataFrame, y: str, x: list[str], penalty: float = 0.01, rounds: int = 100) -> Learner:
    from pyspark.ml.classification import LinearSVC

    return _fit(LinearSVC, df, y, x, regParam=penalty, maxIter=rounds)


class Stumps:
    """AdaBoost of one-split trees: a weighted sum of threshold rules, as a column expression."""

    def __init__(self, rules: list[tuple[str, float, int, float]]) -> None:
        self.rules = rules

    def score(self):
        return sum((F.lit(a) * F.when(F.col(c).cast("double") > t, F.lit(float(s))).otherwise(F.lit(float(-s))) for c, t, s, a in self.rules), F.lit(0.0))

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return df.withColumn(name, (self.score() > 0).cast("int"))


def adaboost(df: DataFrame, y: str, x: list[str], rounds: int = 20, cuts: int = 32) -> Stumps:
    """Discrete AdaBoost of stumps (classes 0 and 1): a round is one aggregate of the weights beyond each cut of each column."""
    points = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [k / cuts for k in range(1, cuts)], 10_000).alias(f"q{i}") for i, c in enumerate(x))).first()
    grid = [(c, float(t)) for i, c in enumerate(x) for t in sorted(set(points[f"q{i}"] or []))]
    sign, model = F.when(F.col(y) == 1, 1.0).otherwise(-1.0), Stumps([])
    for _ in range(rounds):
        w = F.exp(-sign * model.score())
        row = df.agg(F.sum(w).alias("all"), *(F.sum(F.when((F.col(c).cast("double") > t) != (F.col(y) == 1), w).otherwise(0.0)).alias(f"e{k}") for k, (c, t) in enumerate(grid))).first()
        error = np.array([row[f"e{k}"] for k in range(len(grid))]) / row["all"]
        k = int(np.abs(error - 0.5).argmax())
        e = float(np.clip(error[k], 1e-10, 1 - 1e-10))
        if abs(e - 0.5) < 1e-9:
            break
        model.rules.append((*grid[k], 1 if e < 0.5 else -1, abs(0.5 * float(np.log((1 - e) / e)))))
        if min(e, 1 - e) <= 1e-9:
            break
    return model


def partial_dependence(df: DataFrame, learner: Learner, column: str, grid: list[float], probability: bool = False) -> DataFrame:
    """(value, mean): mean prediction over all rows with the column set to each value of the grid."""
    rows = df.crossJoin(df.sparkSession.createDataFrame([(float(g),) for g in grid], "value double")).withColumn(column, F.col("value"))  # a stated grid
    out = learner.probability(rows, "__p") if probability else learner.predict(rows, "__p")
    return out.groupBy("value").agg(F.avg("__p").alias("mean"))


def partial_dependence_2d(df: DataFrame, learner: Learner, columns: tuple[str, str], grids: tuple[list[float], list[float]]) -> DataFrame:
    """(a, b, mean): mean prediction over all rows with two columns set to each pair of values."""
    pairs = df.sparkSession.createDataFrame([(float(a), float(b)) for a in grids[0] for b in grids[1]], "a double, b double")
    rows = df.crossJoin(pairs).withColumns({columns[0]: F.col("a"), columns[1]: F.col("b")})  # a stated grid
    return learner.predict(rows, "__p").groupBy("a", "b").agg(F.avg("__p").alias("mean"))


def ice(df: DataFrame, learner: Learner, id_col: str, column: str, grid: list[float]) -> DataFrame:
    """(id, value, predicted): the prediction of each row along the grid."""
    rows = df.crossJoin(df.sparkSession.createDataFrame([(float(g),) for g in grid], "value double")).withColumn(column, F.col("value"))  # a stated grid
    return learner.predict(rows, "predicted").select(id_col, "value", "predicted")


def permutation_importance(df: DataFrame, learner: Learner, y: str, seed: int = 1) -> DataFrame:
    """(term, increase): growth of the mean squared error when a column is replaced by that of a random other row (drawn by its quantiles)."""
    error = lambda rows: learner.predict(rows, "__p").agg(F.avg((F.col("__p") - F.col(y)) ** 2)).first()[0]
    base, out = error(df), []
    for c in learner.x:
        q = df.agg(F.percentile_approx(F.col(c).cast("double"), [(k + 0.5) / 200 for k in range(200)], 10_000)).first()[0]
        drawn = F.element_at(F.array(*(F.lit(float(v)) for v in q)), (F.floor(F.rand(seed) * len(q)) + 1).cast("int"))
        out.append((c, float(error(df.withColumn(c, drawn)) - base)))
    return df.sparkSession.createDataFrame(out, "term string, increase double")


def shapley(df: DataFrame, learner: Learner, id_col: str, background: dict[str, float]) -> DataFrame:
    """(id, term, value): exact Shapley values of each prediction against background values, over all subsets of up to ten columns."""
    from math import factorial

    x, k = learner.x, len(learner.x)
    if k > 10:
        raise ValueError("more than ten columns")
    masks = df.sparkSession.createDataFrame([(m,) for m in range(1 << k)], "mask int")
    rows = df.select(id_col, *x).crossJoin(masks)  # 2^k rows a row, k columns at most ten
    rows = rows.withColumns({c: F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("double")).otherwise(float(background[c])) for i, c in enumerate(x)})
    told = learner.predict(rows, "__p")
    size = F.bit_count("mask").cast("int")
    weights = F.array(*(F.lit(factorial(s) * factorial(k - s - 1) / factorial(k)) for s in range(k)))
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    parts = [F.sum(F.when(has(i), F.element_at(weights, F.greatest(size, F.lit(1)))).otherwise(-F.element_at(weights, F.least(size + 1, F.lit(k)))) * F.col("__p")).alias(f"v{i}") for i in range(k)]
    got = told.groupBy(id_col).agg(*parts)
    return got.select(id_col, F.inline(F.array(*(F.struct(F.lit(c).alias("term"), F.col(f"v{i}").alias("value")) for i, c in enumerate(x)))))


def quantile_forest(df: DataFrame, y: str, x: list[str], at: DataFrame, id_col: str, probabilities: list[float], trees: int = 20, depth: int = 6, seed: int = 1) -> DataFrame:
    """(id, probability, value): quantiles of the outcomes that share leaves with a row, by weights over the forest's leaves; outcomes are counted per leaf."""
    model = random_forest(df, y, x, False, trees, depth, seed).model.setLeafCol("__leaf")
    from pyspark.ml.functions import vector_to_array

    leaves = lambda rows, label: model.transform(_data(rows, x, label))
    seen = leaves(df, y).select(F.col("__y").alias("y"), F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf")).groupBy("tree", "leaf", "y").agg(F.count("*").alias("n"))
    size = seen.groupBy("tree", "leaf").agg(F.sum("n").alias("size"))
    own = leaves(at, None).select(F.col(id_col).alias("id"), F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf"))
    weights = own.join(size, ["tree", "leaf"]).join(seen, ["tree", "leaf"]).groupBy("id", "y").agg((F.sum(F.col("n") / F.col("size")) / trees).alias("w"))
    from pyspark.sql import Window

    ranked = weights.withColumn("c", F.sum("w").over(Window.partitionBy("id").orderBy("y")))
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in probabilities)))
    return ranked.withColumn("probability", wanted).where(F.col("c") >= F.col("probability") - 1e-9).groupBy("id", "probability").agg(F.min("y").alias("value"))
