"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Ties every neighbour above a node to the least node that it or its neighbours are."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a")
    return links.join(least, "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Ties every node to the least of its lower neighbours, and those neighbours to it as well."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    met = links.join(least, "b")
    down = met.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b) with a < b; a component is named by its least node.

    Every round is two joins on a written table; rounds grow with the logarithm of a component's breadth. Ends when
    every node hangs on one lower node only and no lower node hangs on another. Null ends are no links.
    """
    links = stored(links.where("a < b").select("a", "b").distinct(), "links")
    while True:
        upper, lower = links.select("b"), links.select(F.col("a").alias("b")).distinct()
        n = links.agg(F.count("*"), F.count_distinct("b")).first()
        if n[0] == n[1] and lower.join(upper, "b", "left_semi").isEmpty():
            tops = lower.select(F.col("b").alias("node"), F.col("b").alias("component"))
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(tops)
        before, links = links, stored(_small_star(_large_star(links)), "links")
        removed(before)
