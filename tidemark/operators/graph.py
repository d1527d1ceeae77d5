"""Connected components of a table of links, by alternating rounds of large stars and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the smallest node that links reach. A link from a node to itself gives
    a component of one. Rounds grow with the logarithm of the longest chain; RuntimeError beyond ``most_rounds``."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("least"))
        moved = large.join(least, "b").where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
        edges = cut(moved.union(least.select(F.col("least").alias("a"), "b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError(f"clusters have not settled after {most_rounds} rounds")
    return nodes.join(edges.select(F.col("b").alias("_b"), F.col("a").alias("_a")), F.col("node") == F.col("_b"), "left").select("node", F.coalesce("_a", "node").alias("label"))


def spanning(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(a, b): a link of each node of a task's links to the smallest node that those reach. What is joined stays joined, by as many links as nodes."""

    def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            least = np.minimum(root[i], root[j])
            new = root.copy()
            for side in (i, j):
                np.minimum.at(new, root[side], least)
                np.minimum.at(new, side, least)
            new = new[new]
            if np.array_equal(new, root):
                return nodes, nodes[root]
            root = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count > most:  # links that came since
                held, count = [star(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in star(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")
