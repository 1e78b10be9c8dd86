"""Pairs within small groups, and connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagraph.llm.common import materialize


def all_pairs(members: DataFrame) -> DataFrame:
    """(u, v) of all members of each key, u < v."""
    held = members.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("s"))
    pairs = "explode(flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as u, y as v))))) as p"
    return held.selectExpr(pairs).select("p.u", "p.v")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of whole numbers -> (node, component): the smallest node that each node reaches.

    Nulls and self-links are left out; a node without another has no row. Each round halves what is
    left of the paths, so rounds grow with the logarithm of the longest one.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
