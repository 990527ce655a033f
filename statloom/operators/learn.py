"""Clustering, projection and rules, on Spark's ML where its meaning is the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__features", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, column: str, id_col: str, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """Cluster of each row."""
    from pyspark.ml.clustering import KMeans

    rows = _vectors(df, column)
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(id_col, "cluster")


def pca(df: DataFrame, column: str, k: int) -> DataFrame:
    """Variance and share of the first components; the Gram matrix is summed on the executors."""
    from pyspark.ml.feature import PCA

    rows = _vectors(df.where(F.col(column).isNotNull()), column)
    width = rows.agg(F.max(F.size(column))).first()[0]
    model = PCA(k=k, inputCol="__features", outputCol="__scores").fit(rows)
    total = sum(rows.agg(*(F.var_samp(F.col(column)[i].cast("double")).alias(f"v{i}") for i in range(width))).first())
    return df.sparkSession.createDataFrame([(i + 1, float(v * total), float(v)) for i, v in enumerate(model.explainedVariance.toArray())], "component int, variance double, share double")


def association_rules(df: DataFrame, items: str, support: float, confidence: float) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    rules = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(df).associationRules
    return rules.select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "confidence", "lift", "support")


def norms_by(df: DataFrame, column: str, group: str) -> DataFrame:
    """Rows and mean Euclidean norm per group."""
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(norm).alias("mean_norm"))
