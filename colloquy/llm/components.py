"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def stars(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for every node u of the links (a, b) that is not the smallest of its component, v its smallest; a written table.

    A large star links every larger neighbour of a node with the smallest node around
    it, a small star the same for smaller neighbours; after a few rounds each node is
    linked with the smallest of its component alone. Each step is written to the
    shared folder, and so are its minima: they are pre-aggregated, and the join of a node's
    many links with them can be split. The minima also tell whether a round is needed: no
    node has two links to smaller ones, or one as well as a link to a larger one.
    """
    both = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.keep(links.where(F.col("a") != F.col("b")).select(*both).distinct())
    while True:
        down = edges.select("u", "v", F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
        around = down.union(edges.select("v", "u", F.lit(0), F.lit(1)))
        low = around.groupBy("u").agg(F.min("v").alias("m"), F.sum("smaller").alias("n"), F.max("larger").alias("larger"))
        low = scratch.keep(low.select("u", F.least("u", "m").alias("m"), F.expr("n > 1 or (n = 1 and larger = 1)").alias("open")))
        if low.where("open").isEmpty():
            scratch.drop(low)
            return edges
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        # links that repeat here go with those of the small star: there are no more than edges
        large = scratch.keep(up.join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), "m", F.col("u").alias("own"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("own").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        after = scratch.keep(small.where("u != v").distinct())
        scratch.drop(edges, low, large, least)
        edges = after


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b), component its smallest reachable node."""
    edges = stars(links, scratch)
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
