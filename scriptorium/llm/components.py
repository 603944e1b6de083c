"""Connected components by hooking to the smallest neighbour and pointer jumping, on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import written


def _roots(forest: DataFrame) -> DataFrame:
    """node, component for every node of a forest (a, b: one row for each a, its parent b < a)."""
    while True:
        up = forest.select(F.col("a").alias("b"), F.col("b").alias("c"))
        forest = written(forest.select("a", "b").join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "cc-forest")
        if not forest.where("moved").limit(1).count():
            break
    tops = forest.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return written(forest.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops), "cc-nodes")


def extended(own: DataFrame, links: DataFrame) -> DataFrame:
    """own (node, component) after more links (a, b); nodes that only links have are added."""
    trees = links.join(own.toDF("a", "ca"), "a", "left").join(own.toDF("b", "cb"), "b", "left")
    across = written(trees.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "cc-trees")
    if not across.limit(1).count():
        return own
    upper = components(across)
    joined = own.join(upper.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(joined.unionByName(upper.join(own.select("node"), "node", "left_anti").select("node", "component")), "cc-nodes")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a, b: long); order within a link is free.

    Each node hooks on to its smallest neighbour, if that is smaller: a forest,
    which has fewer edges than nodes, however many links there are.  Every node's
    parent becomes its parent's parent until all point to roots, so rounds are the
    logarithm of the depth.  The trees become nodes, and what links them is solved
    in the same way; every level at least halves the trees that still meet.
    Minima are pre-aggregated before the exchange, each join gives a row for each
    row of its left side, and a hub's rows can be split.  All tables are written to
    the shared folder.  There is no other end than that nothing changes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-links")
    return extended(_roots(written(edges.groupBy("a").agg(F.min("b").alias("b")), "cc-forest")), edges)
