"""Sleep of fly-days: bouts, latency, fragmentation and transition probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.runs import with_run_id
from tidemark.schemas import FLY, SLEEP_FEATURES

KEY = ["fly_id", "exp_day"]
DAY = [*FLY, "exp_day"]


def sleep_bins(bins: DataFrame, bin_minutes: float = 1, threshold: float = 5, movement: str = "n") -> DataFrame:
    """Bins with sleep (in a run of inactive bins of at least ``threshold`` minutes), is_day, and the previous bin's sleep."""
    runs = with_run_id(bins.withColumn("inactive", F.col(movement) == 0), KEY, "datetime", F.col("inactive"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "run_id"))
    asleep = runs.withColumn("sleep", F.col("inactive") & (size * bin_minutes >= threshold))
    before = F.lag("sleep").over(Window.partitionBy(*KEY).orderBy("datetime"))
    return asleep.withColumn("before", before).withColumn("is_day", F.col("zt") < 12)


def sleep_bouts(bins: DataFrame, bin_minutes: float = 1, threshold: float = 5) -> DataFrame:
    """One row for each sleep bout: start, minutes, whether its first bin is in the day."""
    s = sleep_bins(bins, bin_minutes, threshold).where("sleep")
    return s.groupBy(*DAY, "run_id").agg(F.min("datetime").alias("start"), (F.count(F.lit(1)) * bin_minutes).alias("minutes"), F.min_by("is_day", "datetime").alias("is_day")).drop("run_id")


def sleep_daily(bins: DataFrame, bin_minutes: float = 1, threshold: float = 5) -> DataFrame:
    """One row for each fly and day with all sleep measures; undefined ones are null.

    Latency counts the dark bins (zt 12 and later, in order of time) before the first that is asleep; WASO the wakeful ones
    from there on.
    """
    s = sleep_bins(bins, bin_minutes, threshold)
    dark = F.when(F.col("zt") >= 12, 1).otherwise(0)
    so_far = Window.partitionBy(*KEY).orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("dark_n", F.sum(dark).over(so_far)).withColumn("dark_slept", F.max((dark == 1) & F.col("sleep")).over(so_far))
    runs = s.groupBy(*DAY, "run_id", "sleep").agg(
        F.count(F.lit(1)).alias("len"), F.min_by("is_day", "datetime").alias("first_day"), F.count_if(F.col("sleep") & F.col("is_day")).alias("day_sleep"),
        F.count_if(~F.col("sleep") & F.col("before")).alias("wakes"), F.count_if(F.col("sleep") & ~F.col("before")).alias("dozes"),
        F.min(F.when((dark == 1) & F.col("sleep"), F.col("dark_n"))).alias("first_dark"), F.count_if((dark == 1) & ~F.col("sleep") & F.col("dark_slept")).alias("waso"),
    )
    m, slept = F.lit(float(bin_minutes)), F.col("sleep")
    minutes = F.col("len") * m
    day, night = slept & F.col("first_day"), slept & ~F.col("first_day")
    total, n_s, n_w = F.sum("len"), F.sum(F.when(slept, F.col("len")).otherwise(0)), F.sum(F.when(~slept, F.col("len")).otherwise(0))
    # inactive but short runs are awake and join the active runs beside them: a wake bout starts where sleep came before
    wake_bouts = F.sum(F.when(~slept, F.col("wakes")).otherwise(0)) + F.max(F.when(~slept & (F.col("run_id") == 1), 1).otherwise(0))
    some = F.count_if(slept)
    return runs.groupBy(*DAY).agg(
        (n_s * m).alias("total_sleep"), (F.sum("day_sleep") * m).alias("day_sleep"), ((n_s - F.sum("day_sleep")) * m).alias("night_sleep"),
        some.alias("total_bouts"), F.count_if(day).alias("day_bouts"), F.count_if(night).alias("night_bouts"),
        F.avg(F.when(slept, minutes)).alias("mean_bout"), F.max(F.when(slept, minutes)).alias("max_bout"),
        F.avg(F.when(day, minutes)).alias("mean_day_bout"), F.max(F.when(day, minutes)).alias("max_day_bout"),
        F.avg(F.when(night, minutes)).alias("mean_night_bout"), F.max(F.when(night, minutes)).alias("max_night_bout"),
        (some / (total * m / 60)).alias("frag_bouts_per_hour"), F.try_divide(some, n_s * m).alias("frag_bouts_per_min_sleep"),
        F.try_divide(n_w * m, wake_bouts).alias("mean_wake_bout"),
        F.try_divide(F.sum("wakes"), n_s).alias("p_wake"), F.try_divide(F.sum("dozes"), n_w).alias("p_doze"),
        ((F.min("first_dark") - 1) * m).alias("sleep_latency"), F.when(F.min("first_dark").isNotNull(), F.sum("waso") * m).alias("waso"),
    )


def sleep_features(daily: DataFrame) -> DataFrame:
    """Means of the daily measures for each fly, and its number of days."""
    return daily.groupBy(*FLY).agg(*[F.avg(f.removesuffix("_mean")).alias(f) for f in SLEEP_FEATURES], F.count(F.lit(1)).alias("n_days"))
