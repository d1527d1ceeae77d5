"""Rows of the trailing day: for each fly and day the 24 hours that end at lights-on, labelled with status and days to death."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import health, rhythm, sleep
from tidemark.schemas import FLY, LIGHTS_ON

#: Statuses of fly-days as labels; others have none and leave the table.
LABELS = {"Alive": "alive", "Unhealthy": "dying", "Dead": "dead"}


def trailing(bins: DataFrame, bin_minutes: float = 1, hours: int = 24, hour: int = LIGHTS_ON) -> DataFrame:
    """(fly_id, window_end_date, total_activity, activity_mean, activity_var) of the ``hours`` that end at ``hour`` of each day.

    A frame over time ends with each bin, whatever bins are there; those that end at ``hour`` and are whole stay. Windows may
    be longer than a day, and overlap.
    """
    at = F.unix_micros(F.col("datetime").cast("timestamp"))
    span = int((hours * 60 - bin_minutes) * 60_000_000)
    w = Window.partitionBy("fly_id").orderBy("_at").rangeBetween(-span, 0)
    ends = F.col("datetime") + F.make_dt_interval(mins=F.lit(int(bin_minutes)))
    found = bins.withColumn("_at", at).select(
        "fly_id", ends.alias("_ends"), F.sum("n").over(w).cast("double").alias("total_activity"), F.avg("n").over(w).alias("activity_mean"),
        F.var_samp("n").over(w).alias("activity_var"), F.count(F.lit(1)).over(w).alias("_bins"),
    )
    whole = (F.hour("_ends") == hour) & (F.minute("_ends") == 0) & (F.col("_bins") * bin_minutes == hours * 60)
    return found.where(whole).select("fly_id", F.to_date("_ends").alias("window_end_date"), "total_activity", "activity_mean", "activity_var")


def sliding_rows(bins: DataFrame, days: DataFrame, bin_minutes: float = 1, threshold: float = 5, hour: int = LIGHTS_ON) -> DataFrame:
    """One row for each fly and window [hour, hour) that is whole: activity, sleep, amplitude, power, status, days_until_death.

    A window carries the date on which it ends, and that day's status. Its measures are the daily ones over shifted days.
    """
    moved = F.col("datetime") - F.make_dt_interval(hours=F.lit(hour))
    w = bins.withColumn("date", F.date_add(F.to_date(moved), 1)).withColumn("exp_day", F.col("exp_day") + (F.hour("datetime") >= hour).cast("int"))
    daily = health.daily_metrics(w, bin_minutes).withColumnRenamed("total_sleep", "_ts")
    stats = w.groupBy("fly_id", "date").agg(F.avg("n").alias("activity_mean"), F.var_samp("n").alias("activity_var"), F.count(F.lit(1)).alias("_bins"))
    whole = stats.where(F.col("_bins") * bin_minutes == 1440).drop("_bins")
    nights = sleep.sleep_daily(w, bin_minutes, threshold).select("fly_id", "exp_day", F.col("total_sleep").alias("total_sleep_min"), "total_bouts", F.col("mean_bout").alias("mean_bout_min"), F.col("max_bout").alias("max_bout_min"), "frag_bouts_per_hour")
    hourly = rhythm.hourly_totals(w, "n")
    fit = rhythm.cosinor(hourly).select("fly_id", "exp_day", F.col("amplitude").alias("amplitude_24h"))
    power = rhythm.periodogram(hourly).select("fly_id", "exp_day", F.col("periodogram_period").alias("periodogram_period_24h"), F.col("periodogram_power").alias("periodogram_power_24h"))
    death = days.groupBy("fly_id").agg(F.min(F.when(F.col("status") == "Dead", F.col("exp_day"))).alias("_dead"))
    label = F.when(F.col("status_raw") == "Alive", "alive").when(F.col("status_raw") == "Unhealthy", "dying").when(F.col("status_raw") == "Dead", "dead")
    rows = daily.join(whole, ["fly_id", "date"]).join(nights, ["fly_id", "exp_day"], "left").join(fit, ["fly_id", "exp_day"], "left").join(power, ["fly_id", "exp_day"], "left")
    rows = rows.join(days.select("fly_id", "exp_day", F.col("status").alias("status_raw")), ["fly_id", "exp_day"]).join(death, "fly_id", "left")
    return rows.withColumn("status", label).where(F.col("status").isNotNull()).select(
        *FLY, F.col("date").alias("window_end_date"), "exp_day", "total_activity", "activity_mean", "activity_var", (F.col("longest_zero") / 60.0).alias("longest_zero_hours"),
        "total_sleep_min", "total_bouts", "mean_bout_min", "max_bout_min", "frag_bouts_per_hour", "amplitude_24h", "periodogram_period_24h", "periodogram_power_24h",
        "status", "status_raw", (F.col("_dead") - F.col("exp_day")).alias("days_until_death"),
    )


def near_death(rows: DataFrame, within: int = 2) -> DataFrame:
    """Rows with near_death: whether death is 0 to ``within`` days away."""
    return rows.withColumn("near_death", F.coalesce(F.col("days_until_death").between(0, within), F.lit(False)).cast("int"))
