"""Connected components of an edge table by alternating large and small stars.

Every round is a few joins and partial aggregates; a node's neighbours are never
gathered, and every round's edges are stored, so nothing depends on lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import free, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("__a"), F.least("a", "least").alias("least"))
    return (both.where("b > a").join(least, F.col("a") == F.col("__a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("least"))
    moved = down.join(least, F.col("a") == F.col("__a")).where("b <> least").select(F.col("b").alias("a"),
                                                                                    F.col("least").alias("b"))
    return moved.union(least.select("__a", "least")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of comparable nodes -> (node, root): every linked node but the roots, root the smallest."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    before = _state(edges)
    while True:
        last, edges = edges, saved(_small_star(_large_star(edges)), "stars")
        free(last)
        now = _state(edges)
        if now == before:
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found.saved_at = edges.saved_at     # for ``free``
            return found
        before = now
