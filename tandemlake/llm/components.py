"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is an aggregate and a join on a node; a node's neighbours are never gathered in one place. The number of
steps grows with the logarithm of the graph's diameter. Each step's edges are checkpointed, so that the lineage stays
short and a lost executor costs one step at most. So are the aggregates: their joins then stand on exchanges of their
own, whose large partitions (a giant component's root) Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: for every node of edges (a, b), the smallest node of its component. Loops and repeats are harmless; no edges give no rows.

    Raises after `most` steps, which a graph of 2^most nodes in a row would need.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    count = None
    for _ in range(most):
        # large star: neighbours larger than a node go to the least node that the node sees
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = cut(small)
        # settled once every node has one edge and no root is a node with a smaller one
        was, count = count, after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        now = after
        if was == count:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most} steps")
