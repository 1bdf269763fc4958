"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import checkpoint


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node with a link, from edges (a, b) of any type that has an order.

    Each round deals out rows by node and keeps as many links as nodes at most, so long chains take a logarithmic number
    of rounds. Self-links and repeated links are fine; nodes without links are absent; no links give no rows.
    Joins are merged by hint: a round's least neighbours are a row a node, and round after round of them would be broadcast by the driver."""
    links = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        #: Large star: each neighbour above a node is linked to the least of its neighbourhood.
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        #: Small star: each node and its neighbours below are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links, before = checkpoint(small), links
        if _content(links) == _content(before):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    top = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return top.unionByName(top.select(F.col("root").alias("node"), "root").distinct())


def _content(links: DataFrame) -> tuple:
    """Number of links and the sum of their hashes, by which two tables of distinct links are the same or not."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")), F.sum(F.hash("v", "u").cast("long"))).first())
