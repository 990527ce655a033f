"""Connected components of an undirected graph of labelled nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(nodes: DataFrame, links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node that links (a, b) connect with each node.

    Roots spread along links and along the roots' own roots, so the number of
    rounds grows with the logarithm of the longest path. Each round is kept by
    checkpoint() where spark.checkpoint.dir is set.
    """
    shared = nodes.sparkSession.conf.get("spark.checkpoint.dir", None)
    keep = lambda df: df.checkpoint() if shared else df.persist()
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    cur = keep(nodes.select("node", F.col("node").alias("root")))
    for _ in range(rounds):
        near = both.join(cur, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        step = cur.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("least", "root")).alias("root"))
        onward = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = keep(step.join(onward, F.col("root") == F.col("n2"), "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root")))
        same = cur.select("node", F.col("root").alias("was")).join(new, "node").where("was <> root").limit(1).count() == 0
        cur = new
        if same:
            return cur
    raise RuntimeError(f"components unfinished after {rounds} rounds")
