"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.storage import materialize


def _large_stars(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # stored, so that the join has plain shuffles on both sides, which Spark can split
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    return both.join(least, "a").where("b > a").select(F.col("root").alias("a"), "b").where("a < b").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("root"))
    joined = edges.join(least, "b")
    moved = joined.select(F.col("root").alias("a"), F.col("a").alias("b")).where("a < b")
    return moved.union(least.select(F.col("root").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the edges ``a, b``: ``root`` is the smallest node
    it reaches. Nodes without an edge are not listed.

    The minimum of a neighbourhood is aggregated before it is joined back, so the many
    neighbours of one node never meet in one task: the join is one that Spark can split.
    Each round is written to the shared folder, which ends its lineage; the number of
    rounds grows with the logarithm of the longest path. Self-loops and nulls are ignored.
    """
    now = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    mark = None
    while True:
        stars = materialize(_small_stars(_large_stars(now)))
        row = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark, now = tuple(row), stars
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
