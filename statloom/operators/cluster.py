"""Clusterings and their validation.

What scales runs on Spark's ML or on grouped aggregates. The spanning tree, merge
trees and medoids take any number of points that the driver can hold. Other methods that need all
distances work on one bounded set at a time (a group, or the means of many
k-means cells) and refuse more than ``MAX_POINTS`` points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from . import nearest
from .moments import products
from .trees import _data

MAX_POINTS = 4000


def points(df: DataFrame, x: list[str], id_col: str) -> tuple[list, np.ndarray]:
    """Ids and coordinates of a bounded set of rows."""
    got = df.select(id_col, *(F.col(c).cast("double") for c in x)).dropna().orderBy(id_col).limit(MAX_POINTS + 1).collect()
    if len(got) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points: cluster the means of k-means cells instead")
    return [r[0] for r in got], np.array([r[1:] for r in got], dtype=float).reshape(len(got), len(x))


def _every(df: DataFrame, x: list[str], id_col: str):
    """Ids (an Arrow array) and coordinates of all rows without nulls, in the order of the ids."""
    got = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x))).dropna().orderBy("id").toArrow()
    return got.column(0).combine_chunks(), np.column_stack([got.column(i + 1).to_numpy() for i in range(len(x))])


def _table(df: DataFrame, schema: str, *columns) -> DataFrame:
    """Rows of Arrow or numpy columns."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    return df.sparkSession.createDataFrame(pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names), schema)


def distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    return np.sqrt(np.clip(s[:, None] + s[None, :] - 2 * x @ x.T, 0, None))


def _told(df: DataFrame, id_col: str, ids: list, cluster) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, int(c)) for i, c in zip(ids, cluster, strict=True)], f"{id_col} {dict(df.dtypes)[id_col]}, cluster int")


def gaussian_mixture(df: DataFrame, x: list[str], id_col: str, k: int, seed: int = 1, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Most likely component of each row with its probability, and the components' weights and means."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    model = GaussianMixture(k=k, seed=seed, maxIter=rounds, featuresCol="__features", predictionCol="cluster").fit(_data(df, x))
    rows = model.transform(_data(df, x)).select(id_col, "cluster", F.array_max(vector_to_array("probability")).alias("probability"))
    parts = [(i, float(w), [float(v) for v in g.mean.toArray()]) for i, (w, g) in enumerate(zip(model.weights, model.gaussians, strict=True))]
    return rows, df.sparkSession.createDataFrame(parts, "component int, weight double, mean array<double>")


def bisecting_kmeans(df: DataFrame, x: list[str], id_col: str, k: int, seed: int = 1) -> DataFrame:
    """Divisive clustering: the largest cluster is split in two until there are k."""
    from pyspark.ml.clustering import BisectingKMeans

    return BisectingKMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster").fit(_data(df, x)).transform(_data(df, x)).select(id_col, "cluster")


def spherical_kmeans(df: DataFrame, x: list[str], id_col: str, k: int, seed: int = 1) -> DataFrame:
    """k-means by the cosine."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="__features", predictionCol="cluster").fit(_data(df, x))
    return model.transform(_data(df, x)).select(id_col, "cluster")


def trimmed_kmeans(df: DataFrame, x: list[str], id_col: str, k: int, trim: float = 0.1, seed: int = 1, rounds: int = 20) -> DataFrame:
    """k-means whose farthest share of rows has no part in the means; those rows get cluster -1. A round is two aggregates."""
    from pyspark.ml.clustering import KMeans

    cols = [F.col(c).cast("double") for c in x]
    centres = np.array([c for c in KMeans(k=k, seed=seed, featuresCol="__features").fit(_data(df, x)).clusterCenters()])
    rows = df
    for _ in range(rounds):
        far = F.array(*(sum(((c - float(m)) ** 2 for c, m in zip(cols, centre, strict=True)), F.lit(0.0)) for centre in centres))
        rows = df.withColumn("__d", F.array_min(far)).withColumn("__k", F.array_position(far, F.array_min(far)).cast("int") - 1)
        cut = rows.agg(F.percentile_approx("__d", 1 - trim, 10_000)).first()[0]
        got = rows.where(F.col("__d") <= cut).groupBy("__k").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).collect()
        new = centres.copy()
        for r in got:
            new[r["__k"]] = [r[f"m{i}"] for i in range(len(x))]
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-6:
            break
    return rows.select(id_col, F.when(F.col("__d") <= cut, F.col("__k")).otherwise(-1).alias("cluster"))


def fuzzy_cmeans(df: DataFrame, x: list[str], id_col: str, k: int, fuzzy: float = 2.0, seed: int = 1, rounds: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """Memberships of each row in k clusters, and the centres: a round is one aggregate of weighted sums."""
    from pyspark.ml.clustering import KMeans

    cols = [F.col(c).cast("double") for c in x]
    centres = np.array(KMeans(k=k, seed=seed, maxIter=2, featuresCol="__features").fit(_data(df, x)).clusterCenters())

    def member(at):
        near = [F.pow(F.greatest(sum(((c - float(m)) ** 2 for c, m in zip(cols, centre, strict=True)), F.lit(0.0)), F.lit(1e-12)), -1 / (fuzzy - 1)) for centre in at]
        whole = sum(near, F.lit(0.0))
        return [v / whole for v in near]

    for _ in range(rounds):
        u = [F.pow(v, fuzzy) for v in member(centres)]
        row = df.agg(*(F.sum(u[i]).alias(f"w{i}") for i in range(k)), *(F.sum(u[i] * c).alias(f"s{i}_{j}") for i in range(k) for j, c in enumerate(cols))).first()
        new = np.array([[row[f"s{i}_{j}"] / row[f"w{i}"] for j in range(len(x))] for i in range(k)])
        done = np.abs(new - centres).max() < tolerance
        centres = new
        if done:
            break
    return df.select(id_col, F.array(*member(centres)).alias("membership")), centres


def dbscan(df: DataFrame, x: list[str], id_col: str, radius: float, least: int = 5) -> DataFrame:
    """Density clustering of points of two or three columns: neighbours by a join of grid cells, clusters as components of core points; noise is -1.

    Cells of half a diagonal's width hold only mutual neighbours, so a crowded
    cell's points are linked to the cell instead of to each other.
    """
    if not 1 <= len(x) <= 3:
        raise ValueError("one to three columns")
    side = radius / len(x) ** 0.5
    rows = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x))).dropna()
    rows = rows.withColumns({f"c{i}": F.floor(F.col(f"x{i}") / side) for i in range(len(x))})
    cell = [f"c{i}" for i in range(len(x))]
    crowd = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    rows = rows.join(crowd, cell)
    reach = range(-int(np.ceil(len(x) ** 0.5)), int(np.ceil(len(x) ** 0.5)) + 1)
    shifts = [()]
    for _ in x:
        shifts = [(*s, d) for s in shifts for d in reach]
    around = F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(cell, s, strict=True))) for s in shifts)))
    left = rows.where(F.col("n") < least).select("id", *(F.col(f"x{i}").alias(f"a{i}") for i in range(len(x))), around.alias("at")).select("id", *(f"a{i}" for i in range(len(x))), *(F.col(f"at.{c}").alias(c) for c in cell))
    near = sum(((F.col(f"a{i}") - F.col(f"x{i}")) ** 2 for i in range(len(x))), F.lit(0.0)) <= radius * radius
    other = rows.select(F.col("id").alias("other"), *(f"x{i}" for i in range(len(x))), *cell)
    sparse = left.join(other, cell).where(near).groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("id")
    core = rows.where(F.col("n") >= least).select("id").unionByName(sparse)
    cores = rows.join(core, "id")
    # cores of one cell are one cluster: the least id stands for the cell; links lead from cells to cells
    head = cores.groupBy(*cell).agg(F.min("id").alias("head"))
    named = cores.join(head, cell)
    a = named.select(F.col("head").alias("ha"), *(F.col(f"x{i}").alias(f"a{i}") for i in range(len(x))), around.alias("at")).select("ha", *(f"a{i}" for i in range(len(x))), *(F.col(f"at.{c}").alias(c) for c in cell))
    links = a.join(named, cell).where((F.col("ha") < F.col("head")) & near).select(F.col("ha").alias("a"), F.col("head").alias("b")).distinct()
    from .graph import components

    roots = components(head.select(F.col("head").alias("node")), links)
    core_of = named.join(roots, F.col("head") == F.col("node")).select("id", "root", *(f"x{i}" for i in range(len(x))), *cell)
    rest = rows.join(core, "id", "left_anti").select("id", *(F.col(f"x{i}").alias(f"a{i}") for i in range(len(x))), around.alias("at")).select("id", *(f"a{i}" for i in range(len(x))), *(F.col(f"at.{c}").alias(c) for c in cell))
    border = rest.join(core_of.drop("id"), cell).where(near).groupBy("id").agg(F.min("root").alias("root"))
    known = core_of.select("id", "root").unionByName(border)
    return rows.select("id").join(known, "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", F.lit(-1)).alias("cluster"))


def hierarchical(df: DataFrame, x: list[str], id_col: str, linkage: str = "average") -> DataFrame:
    """(step, a, b, height, size): merges of all rows, which the driver holds, by single, complete, average or ward linkage; points are numbered by id, new clusters on from them."""
    if linkage not in ("single", "complete", "average", "ward"):
        raise ValueError(f"unknown linkage {linkage!r}")
    from .linkage import merged

    _, z = _every(df, x, id_col)
    unlike, _, of = nearest.distinct(z)
    a, b, height, size = merged(unlike, of, linkage, df.sparkSession)
    return _table(df, "step int, a int, b int, height double, size int", np.arange(1, len(a) + 1, dtype=np.int32), a.astype(np.int32), b.astype(np.int32), height, size.astype(np.int32))


def cut_tree(merges: DataFrame, k: int | None = None, height: float | None = None) -> list[int]:
    """Cluster of each point (numbered by first appearance) after stopping at k clusters or at a height."""
    rows = merges.orderBy("step").collect()
    n = len(rows) + 1
    parent = list(range(2 * n - 1))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in rows:
        if (k is not None and n - r["step"] < k) or (height is not None and r["height"] > height):
            break
        parent[root(r["a"])] = parent[root(r["b"])] = n + r["step"] - 1
    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen)) for i in range(n)]


def kmedoids(df: DataFrame, x: list[str], id_col: str, k: int, rounds: int = 100) -> DataFrame:
    """Partition around medoids of all rows, which the driver holds, started greedily; swaps until no one helps."""
    from .medoids import medoids

    ids, z = _every(df, x, id_col)
    unlike, _, of = nearest.distinct(z)
    chosen = medoids(unlike, np.bincount(of).astype(float), k, rounds)
    label, least = np.zeros(len(unlike), dtype=np.int32), np.full(len(unlike), np.inf)
    for i, c in enumerate(chosen):
        d = nearest.squares(unlike, unlike[c][None])
        label[d < least], least = i, np.minimum(d, least)
    return _table(df, f"{id_col} {dict(df.dtypes)[id_col]}, cluster int", ids, label[of])


def spectral(df: DataFrame, x: list[str], id_col: str, k: int, gamma: float = 1.0) -> DataFrame:
    """Spectral clustering by power iteration over the affinities of near points, on Spark's ML."""
    from pyspark.ml.clustering import PowerIterationClustering

    ids, z = points(df, x, id_col)
    w = np.exp(-gamma * distances(z) ** 2)
    pairs = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.triu_indices(len(ids), 1), strict=True) if w[i, j] > 1e-8]
    got = PowerIterationClustering(k=k, maxIter=40, initMode="degree", srcCol="a", dstCol="b", weightCol="w").assignClusters(df.sparkSession.createDataFrame(pairs, "a long, b long, w double"))
    at = {r["id"]: r["cluster"] for r in got.collect()}
    return _told(df, id_col, ids, [at.get(i, -1) for i in range(len(ids))])


def mst(df: DataFrame, x: list[str], id_col: str) -> DataFrame:
    """(a, b, distance): the minimum spanning tree of all rows, which the driver holds; equal rows hang on the first of them."""
    ids, z = _every(df, x, id_col)
    kind = dict(df.dtypes)[id_col]
    unlike, first, of = nearest.distinct(z)
    i, j, s = nearest.spanning_tree(unlike)
    rows = np.arange(len(z))
    copies = rows[first[of] != rows]
    tree = nearest.walked(len(z), np.concatenate([first[i], first[of[copies]]]), np.concatenate([first[j], copies]), np.concatenate([np.sqrt(s), np.zeros(len(copies))]))
    a, b, d = (np.array(v, dtype=t) for v, t in zip(zip(*tree, strict=True), (np.int64, np.int64, float), strict=True)) if tree else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return _table(df, f"a {kind}, b {kind}, distance double", ids.take(_indices(a)), ids.take(_indices(b)), d)


def _indices(at: np.ndarray):
    import pyarrow as pa

    return pa.array(at)


def classical_scaling(df: DataFrame, x: list[str], id_col: str, k: int = 2) -> DataFrame:
    """(id, coordinates): classical multidimensional scaling; of Euclidean columns these are principal scores, so any number of rows will do."""
    row = df.agg(*(F.avg(F.col(c).cast("double")) for c in x)).first()
    z = [F.col(c).cast("double") - m for c, m in zip(x, row, strict=True)]
    values, vectors = np.linalg.eigh(products(df, z))
    top = vectors[:, np.argsort(-values)[:k]]
    top = top * np.where(top[np.abs(top).argmax(axis=0), range(k)] < 0, -1, 1)
    return df.select(id_col, F.array(*(sum((float(top[i, j]) * z[i] for i in range(len(x))), F.lit(0.0)) for j in range(k))).alias("coordinates"))


def _sums(df: DataFrame, x: list[str], cluster: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Numbers, means and sums of squared distances from the mean of each cluster, from one aggregate."""
    cols = [F.col(c).cast("double") for c in x]
    got = df.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), sum((F.var_pop(c) for c in cols), F.lit(0.0)).alias("v")).orderBy(cluster).collect()  # a row per cluster
    n = np.array([r["n"] for r in got], float)
    return n, np.array([[r[f"m{i}"] for i in range(len(x))] for r in got]), n * np.array([r["v"] for r in got]), [r[0] for r in got]


def calinski_harabasz(df: DataFrame, x: list[str], cluster: str) -> float:
    n, m, w, _ = _sums(df, x, cluster)
    centre = (n[:, None] * m).sum(axis=0) / n.sum()
    return float((n[:, None] * (m - centre) ** 2).sum() / (len(n) - 1) / (w.sum() / (n.sum() - len(n))))


def davies_bouldin(df: DataFrame, x: list[str], cluster: str) -> float:
    """Mean over clusters of the worst ratio of spreads (mean distances from the mean) to the distance of the means."""
    n, m, _, names = _sums(df, x, cluster)
    means = df.sparkSession.createDataFrame([(name, *map(float, row)) for name, row in zip(names, m, strict=True)], f"`{cluster}` {dict(df.dtypes)[cluster]}, " + ", ".join(f"__m{i} double" for i in range(len(x))))
    far = F.sqrt(sum(((F.col(c).cast("double") - F.col(f"__m{i}")) ** 2 for i, c in enumerate(x)), F.lit(0.0)))
    got = df.join(F.broadcast(means), cluster).groupBy(cluster).agg(F.avg(far).alias("s")).orderBy(cluster).collect()  # a row per cluster
    s = np.array([r["s"] for r in got])
    d = distances(m)
    np.fill_diagonal(d, np.inf)
    return float(((s[:, None] + s[None, :]) / d).max(axis=1).mean())


def silhouette(df: DataFrame, x: list[str], cluster: str) -> float:
    """Mean silhouette by squared Euclidean distances, from cluster sums (no pairs of rows)."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _data(df, x).withColumn("__k", F.col(cluster).cast("double"))
    return ClusteringEvaluator(featuresCol="__features", predictionCol="__k").evaluate(rows)


def dunn(df: DataFrame, x: list[str], id_col: str, cluster: str) -> float:
    """Least distance between clusters over the largest within one, of a bounded set."""
    ids, z = points(df, x, id_col)
    of = {r[0]: r[1] for r in df.select(id_col, cluster).collect()}
    k, d = np.array([of[i] for i in ids]), distances(z)
    same = k[:, None] == k[None, :]
    return float(d[~same].min() / d[same].max())


def agreement(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Rand, adjusted Rand and normalised mutual information of two clusterings, from the counts of their cells."""
    from math import log

    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    info = lambda c: F.sum(F.col(c) * F.ln(c))
    both = cells.agg(pairs("n"), info("n"), F.sum("n")).first()
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n"), info("n")).first()
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n"), info("n")).first()
    n = both[2]
    whole = n * (n - 1) / 2
    rand = (whole + 2 * both[0] - ra[0] - rb[0]) / whole
    expected, top = ra[0] * rb[0] / whole, (ra[0] + rb[0]) / 2
    ha, hb = log(n) - ra[1] / n, log(n) - rb[1] / n
    mutual = ha + hb - (log(n) - both[1] / n)
    return {"rand": rand, "adjusted_rand": (both[0] - expected) / (top - expected) if top != expected else 1.0, "nmi": 2 * mutual / (ha + hb) if ha + hb else 1.0}


def gap_statistic(df: DataFrame, x: list[str], most: int = 6, references: int = 5, seed: int = 1) -> DataFrame:
    """(k, gap, error, chosen): log within-sums of squares against those of uniform rows over the same box."""
    from pyspark.ml.clustering import KMeans

    spark = df.sparkSession
    box = df.agg(*(f(F.col(c).cast("double")) for c in x for f in (F.min, F.max)), F.count("*")).first()
    n = box[len(x) * 2]
    whole = lambda rows: rows.agg(sum((F.var_pop(F.col(c).cast("double")) for c in x), F.lit(0.0)) * F.count("*")).first()[0]
    cost = lambda rows, k: float(np.log(max(whole(rows), 1e-300))) if k == 1 else float(np.log(max(KMeans(k=k, seed=seed, featuresCol="__features").fit(_data(rows, x)).summary.trainingCost, 1e-300)))
    drawn = [spark.range(n).select(*((F.rand(seed + 97 * r + i) * (box[2 * i + 1] - box[2 * i]) + box[2 * i]).alias(c) for i, c in enumerate(x))) for r in range(references)]
    out = []
    for k in range(1, most + 1):
        ref = np.array([cost(d, k) for d in drawn])
        out.append((k, float(ref.mean() - cost(df, k)), float(ref.std() * (1 + 1 / references) ** 0.5)))
    best = next((k for (k, g, _), (_, h, s) in zip(out, out[1:], strict=False) if g >= h - s), most)
    return spark.createDataFrame([(*o, o[0] == best) for o in out], "k int, gap double, error double, chosen boolean")


def normal_mixture(df: DataFrame, column: str, k: int, rounds: int = 500, tolerance: float = 1e-8) -> DataFrame:
    """(component, weight, mean, sd): a one-dimensional normal mixture by EM; a round is one aggregate."""
    v = F.col(column).cast("double")
    q = df.agg(F.percentile_approx(v, [(i + 0.5) / k for i in range(k)], 10_000), F.stddev_samp(v), F.count(v)).first()
    mean, sd, w, n = np.array(q[0], float), np.full(k, q[1] / k), np.full(k, 1 / k), q[2]
    last = -np.inf
    for _ in range(rounds):
        dens = [float(w[i] / (sd[i] * np.sqrt(2 * np.pi))) * F.exp(-0.5 * ((v - float(mean[i])) / float(sd[i])) ** 2) for i in range(k)]
        whole = F.greatest(sum(dens, F.lit(0.0)), F.lit(1e-300))
        row = df.where(v.isNotNull()).agg(F.sum(F.ln(whole)).alias("l"), *(f.alias(f"{a}{i}") for i in range(k) for a, f in (("w", F.sum(dens[i] / whole)), ("m", F.sum(dens[i] / whole * v)), ("q", F.sum(dens[i] / whole * (v - float(mean[i])) ** 2))))).first()
        size = np.array([row[f"w{i}"] for i in range(k)])
        new = np.array([row[f"m{i}"] for i in range(k)]) / size
        sd = np.sqrt(np.maximum(np.array([row[f"q{i}"] for i in range(k)]) / size - (new - mean) ** 2, 1e-12))
        mean, w = new, size / n
        if abs(row["l"] - last) < tolerance * abs(row["l"]):
            break
        last = row["l"]
    order = np.argsort(mean)
    return df.sparkSession.createDataFrame([(j, float(w[i]), float(mean[i]), float(sd[i])) for j, i in enumerate(order)], "component int, weight double, mean double, sd double")


def chi2_outliers(df: DataFrame, x: list[str], level: float = 0.999) -> DataFrame:
    """Rows whose squared Mahalanobis distance is beyond a chi-squared quantile."""
    from .inference import mahalanobis

    cut = special.inverse(lambda v: 1 - special.chi2_upper(v, len(x)), level, 0.0, 1e3)
    return mahalanobis(df, x, "distance").where(F.col("distance") > cut)
