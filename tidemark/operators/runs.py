"""Runs of equal values in ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_run_id(df: DataFrame, keys: list[str], order: str, flag: Column, name: str = "run_id") -> DataFrame:
    """Number the runs of ``flag`` within each group, from 1. One sort serves the lag and the running sum."""
    w = Window.partitionBy(*keys).orderBy(order)
    opens = (~flag.eqNullSafe(F.lag("_flag").over(w))).cast("int")
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_flag", flag).withColumn("_opens", F.when(first, 1).otherwise(opens))
    return marked.withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag", "_opens")


def run_lengths(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """One row for each run: keys, run_id, flag, length, start. The grouping reuses the window's partitioning."""
    runs = with_run_id(df.withColumn("flag", flag), keys, order, F.col("flag"))
    return runs.groupBy(*keys, "run_id", "flag").agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("start"))
