"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import cut


def are_stars(edges: DataFrame) -> bool:
    """Whether every node (u, v) links down to one smaller node, which links down no further."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()[0]


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (itself included). An edge may come twice."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each linked node's smallest reachable node.

    edges: two integer columns, in any direction, with repeats and loops. Nodes without a link
    to another are not listed; rows with a null end are no links. No links give no rows. Each
    round is a written table; the last is the one that leaves every component a star around its
    smallest node.
    """
    pairs = edges.toDF("u", "v").filter("u is not null and v is not null and u != v")
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not are_stars(now):
        now = cut(small_star(large_star(now)), "edges")
    return now.toDF("node", "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
