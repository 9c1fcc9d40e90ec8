"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundwise.llm.shared import cut


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return others.union(own).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reached.

    Neighbourhoods are only reduced to their minimum (partial aggregates) and joined, never
    collected, so a hub holding a third of all links is split like any skewed join key.
    Each round is cut into the shared folder. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    current, seen = edges, None
    while True:
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0:
            return spark.createDataFrame([], "node long, root long")
        if mark == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b"))).distinct()
        seen = mark
        current = cut(small_star(large_star(current)), "components")
