"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import settle


def _are_stars(edges: DataFrame) -> bool:
    """Every node is a centre or a leaf of one centre: u is the leaf, v the centre."""
    leaf = F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"))
    centre = F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"))
    ends = edges.select(F.explode(F.array(leaf, centre)).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.leaf").alias("leaf"), F.min("e.leaf").alias("centre"))
    return nodes.filter("leaf > 1 OR leaf = 1 AND centre = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of an edge table (a, b).

    A node with very many edges is no bottleneck: smallest neighbours are aggregated before the
    shuffle, and go to the edges by a join with a stored table, which can split such a node.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    edges = settle(edges.distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # Large star: larger neighbours of a node move to its smallest neighbour.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
