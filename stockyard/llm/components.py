"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.session import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point a node's larger (or smaller) neighbours, and the node, to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(least, "u").withColumn("m", F.least("u", "m"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` with columns a and b, to node and component: the least node that it reaches.

    Nodes without a link are left out. Each round writes its links to the shared
    folder; the rounds grow with the logarithm of the largest component. An inner
    join of links with one row per node is all that a hot node takes part in.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = store(edges, "links")
    seen = None
    while True:
        after = store(_star(_star(edges, large=True), large=False), "links")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        edges = after
        if mark == seen:
            break
        seen = mark
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return member.unionByName(heads)
