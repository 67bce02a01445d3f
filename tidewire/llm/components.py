"""Connected components of links that lie in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stored


def pointer_roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), where every node has one parent and no chain comes back: jumps double each round."""
    now = stored(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = stored(now.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"),
                                                          F.col("above").isNotNull().alias("moved")), "roots")
        now = step.select("node", "root")
        if step.where("moved").isEmpty():
            return now


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach from each; nodes without links are left out.

    Each round, every node hands the smallest neighbour (itself included) to its larger neighbours, then to its smaller
    ones; links become stars around the smallest node of a component. Copies of a link combine before they are shuffled.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), "n").where("u <> v")
        after = stored(small.select("u", "v").union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        # done when all links go from a node to a root that has no link further down
        roots = after.select(F.col("v").alias("u")).distinct()
        done = after.groupBy("u").count().where("count > 1").isEmpty() and after.join(roots, "u", "left_semi").isEmpty()
        edges = after
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
