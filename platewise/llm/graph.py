"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import drop_stored, stored


def _all_stars(edges: DataFrame) -> bool:
    """Whether every edge u > v joins a leaf to its root: no leaf has two edges, and no root is a leaf. The nodes are aggregated
    before the shuffle, so a hub costs one row for each task."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("edges"), F.min("leaf").alias("leaf"))
    return nodes.filter((F.col("edges") > 1) | ((F.col("edges") == 1) & (F.col("leaf") == 0))).isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges u > v. Each node hands its smallest neighbour to its larger (large star) or smaller (small
    star) neighbours. The minima are aggregated before the shuffle, so a hub costs one row for each task, and stored, so
    that they join as a plain table and Spark can split a hub's rows."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    pairs = both.join(least, "u")
    if large:
        out = pairs.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = stored(out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    drop_stored(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (columns a, b): root is the smallest node of its component. Each
    round is written to the shared folder; the number of rounds grows with the logarithm of the graph, and stars take none."""
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _all_stars(edges):
        half = _star(edges, large=True)
        drop_stored(edges)
        edges = _star(half, large=False)
        drop_stored(half)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
