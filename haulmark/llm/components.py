"""Connected components by alternating large-star and small-star, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node that it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``, longs) but the roots themselves.

    The root is the smallest node of the component. Rounds go on until each node has one edge
    left, to a node that has none: then only stars are left. Minima are combined before the
    shuffle and the edges of a hub are joined, not gathered, so no task holds all neighbours of a
    node; every round is written to the shared folder. Loops and repeated edges do not matter,
    and no edges give no rows.
    """
    clean = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(clean)
    while True:
        now = stored(_small_star(_large_star(now)))
        inner = now.select(F.col("b").alias("a")).distinct()
        repeated = now.groupBy("a").count().filter("count > 1").limit(1)
        if repeated.unionAll(now.join(inner, "a", "left_semi").select("a", F.lit(1).alias("count")).limit(1)).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
