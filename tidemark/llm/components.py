"""Connected components of a link table by alternating large-star and small-star rounds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest neighbour."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), "b")).distinct()


def component_labels(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): label is the smallest node that links reach.

    Rounds grow with the logarithm of the longest chain. Each round is written to the shared folder, and only its row
    count and a sum of hashes reach the driver. No links: no rows. Self-links and repeated links change nothing.
    """
    edges = scratch.keep(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    before = None
    for _ in range(most_rounds):
        # the sums are taken while the round is written; each row counts once there
        seen = Observation()
        marks = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
        now = scratch.keep(_small_star(_large_star(edges)).observe(seen, *marks))
        scratch.drop(edges)
        edges, mark = now, (seen.get["n"], seen.get["sum"])
        if mark == before or mark[0] == 0:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select("a", "a").distinct())
