"""Places in a global order, and differences along it, without a window over the whole table.

Rows are dealt into ranges and sorted there; a row's place is its place in its range plus the rows of the ranges before, of which
there are as many as partitions. Ties go by all columns named, which should tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: Rows of a stretch within which neighbours are looked up.
STRETCH = 1 << 16


def numbered(df: DataFrame, by: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with ``name``: a row's place in the order of ``by``, from 0. The sorted rows are written once."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the id holds the partition and, from 0, the row's place there
    marked = cut(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before, so_far = {}, 0
    for r in sorted(marked.groupBy(part.alias("p")).count().collect()):  # one row for each partition
        before[r["p"]], so_far = so_far, so_far + r["count"]
    if not before:
        return marked.withColumn(name, F.lit(0).cast("long")).drop("_id")
    start = marked.sparkSession.createDataFrame(list(before.items()), "_p long, _before long")
    return marked.withColumn("_p", part).join(F.broadcast(start), "_p").withColumn(name, F.col("_before") + at).drop("_id", "_p", "_before")


def with_next(df: DataFrame, value: str, place: str, steps: int, stretch: int = STRETCH) -> DataFrame:
    """``df`` with next1 .. next<steps>: ``value`` so many places on, null past the end. ``place`` counts from 0 without gaps.

    Rows are cut into stretches; the first rows of each are copied to those before that look at them.
    """
    own, back = F.floor(F.col(place) / stretch).cast("long"), F.floor((F.col(place) - steps) / stretch).cast("long")
    copies = df.withColumn("_own", own).withColumn("_in", F.explode(F.sequence(back, own)))
    w = Window.partitionBy("_in").orderBy(place)
    out = copies.withColumns({f"next{k}": F.lead(value, k).over(w) for k in range(1, steps + 1)})
    return out.where("_in = _own").drop("_in", "_own")
