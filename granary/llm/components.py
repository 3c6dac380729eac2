"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored


def _digest(edges: DataFrame) -> tuple:
    """Count and hash sum of distinct edges, in one pass."""
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each node of the (a, b) long edges with the least id it can reach.

    Returns node, label, one row per node that has an edge. Rounds of large-star
    and small-star steps: every node passes the least neighbour on, first to its
    larger neighbours, then to its smaller ones, until the edges are stars around
    the least nodes. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the graph's size, and only counts come to
    the driver.
    """
    now = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    digest = _digest(now)
    while True:
        # Large star: every neighbour above a node goes to its least neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("least"))
        small = large.join(low, "b").select(
            F.explode(
                F.array(
                    F.struct(F.col("least").alias("a"), F.col("b").alias("b")),
                    F.struct(F.col("least").alias("a"), F.col("a").alias("b")),
                )
            ).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(small)
        # Done when the edges stay the same.
        digest, before = _digest(after), digest
        if digest == before:
            break
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )
