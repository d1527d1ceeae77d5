"""Daily activity, status of fly-days, and the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.operators.runs import with_run_id
from tidemark.schemas import FLY, LIGHTS_OFF, LIGHTS_ON, META, REF_DAY, THRESHOLDS

DAY = [*FLY, "date", "exp_day"]


def daily_metrics(bins: DataFrame, bin_minutes: int = 1, count: str = "n", lights_on: float = LIGHTS_ON, lights_off: float = LIGHTS_OFF, window: float = THRESHOLDS["transition_minutes"]) -> DataFrame:
    """One row for each fly and day, from one pass over its bins.

    total_activity (0 if nothing was read), activity_index (share of bins above 0), longest_zero and total_sleep in minutes
    (sleep is zero runs of at least 5 bins), missing_frac, transition_counts and no_startle (nothing near lights-on or -off;
    false for days without bins there count as nothing, so true).
    """
    c = F.col(count)
    marked = bins.select(*DAY, "datetime", count, (c == 0).alias("_zero"), tp.near_transition(F.col("datetime"), lights_on, lights_off, window).alias("_edge"))
    runs = with_run_id(marked, ["fly_id", "date"], "datetime", F.col("_zero"))
    each = runs.groupBy(*DAY, "run_id", "_zero").agg(
        F.count(F.lit(1)).alias("len"), F.sum(count).alias("total"), F.count_if(c > 0).alias("active"), F.count_if(c.isNull()).alias("missing"), F.sum(F.when(F.col("_edge"), c)).alias("edge")
    )
    zero = F.when(F.col("_zero"), F.col("len"))
    days = each.groupBy(*DAY).agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total_activity"),
        (F.sum("active") / F.sum("len")).alias("activity_index"),
        (F.coalesce(F.max(zero), F.lit(0)) * bin_minutes).cast("long").alias("longest_zero"),
        (F.coalesce(F.sum(F.when(F.col("len") >= 5, zero)), F.lit(0)) * bin_minutes).cast("long").alias("total_sleep"),
        (F.sum("missing") / F.sum("len")).alias("missing_frac"),
        F.coalesce(F.sum("edge"), F.lit(0)).cast("long").alias("transition_counts"),
    )
    return days.withColumn("no_startle", F.col("transition_counts") == 0)


def with_decline(daily: DataFrame, ref_day: int = REF_DAY, t: dict = THRESHOLDS) -> DataFrame:
    """Activity relative to the reference day, by a window over the fly's days instead of a join.

    A reference of 0 has no ratio and reads Stable; a missing reference reads No Reference.
    """
    ref = F.max(F.when(F.col("exp_day") == ref_day, F.col("total_activity"))).over(Window.partitionBy("fly_id"))
    rel = F.try_divide(F.col("total_activity"), F.col("ref_activity"))
    label = (
        F.when(F.col("ref_activity").isNull(), "No Reference").when(F.col("rel_activity") < t["death"], "Dead (by decline)")
        .when(F.col("rel_activity") < t["decline"], "Unhealthy (by decline)").otherwise("Stable")
    )
    return daily.withColumn("ref_activity", ref).withColumn("rel_activity", rel).withColumn("decline_status", label)


def with_status(daily: DataFrame, bin_minutes: int = 1, apply_decline: bool = False, t: dict = THRESHOLDS, a_in_bins: bool = False) -> DataFrame:
    """Flags and status of each fly-day: the first rule that holds decides.

    Zero runs and thresholds are minutes. With ``a_in_bins`` A1 and A2 are first divided by the length of a bin, as pipelines do
    that meant minute bins; the two agree there.
    """
    per = bin_minutes if a_in_bins else 1
    dead_a2, dead_a1 = F.col("longest_zero") >= t["A2"] / per, F.col("longest_zero") >= t["A1"] / per
    low = (F.col("total_activity") <= t["activity_low"]) | (F.col("activity_index") <= t["index_low"])
    sleepy = (F.col("total_sleep") >= t["sleep_max"]) | (F.col("longest_zero") >= t["sleep_bout"])
    flags = {"flag_a2": dead_a2, "flag_a1": dead_a1, "flag_low_activity": low, "flag_sleep": sleepy, "flag_missing": F.col("missing_frac") > t["missing_max"]}
    df = daily.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    quiet = F.coalesce(F.col("no_startle"), F.lit(False))
    status = F.when(F.col("flag_a2") | (F.col("flag_a1") & quiet), "Dead")
    if apply_decline:
        status = status.when(F.col("decline_status") == "Dead (by decline)", "Dead")
    status = status.when((F.col("flag_low_activity") | F.col("flag_sleep")) & quiet, "Unhealthy")
    if apply_decline:
        status = status.when(F.col("decline_status") == "Unhealthy (by decline)", "Unhealthy")
    return df.withColumn("status", status.when(F.col("flag_missing"), "QC_Fail").otherwise("Alive"))


def irreversible(days: DataFrame) -> DataFrame:
    """A fly once Dead is Dead on all its later days."""
    w = Window.partitionBy("fly_id").orderBy("exp_day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("status", F.when(F.max(F.col("status") == "Dead").over(w), "Dead").otherwise(F.col("status")))


def health_report(days: DataFrame) -> DataFrame:
    """One row for each fly with usable metadata: days by status, first and last days, final status."""
    is_ = lambda s: F.col("status") == s
    good = days
    for c in META:
        good = good.where(tp.is_ok(F.col(c)))
    return good.groupBy(*FLY).agg(
        F.count(F.lit(1)).alias("days_analyzed"), F.count_if(is_("Alive")).alias("days_alive"), F.count_if(is_("Unhealthy")).alias("days_unhealthy"),
        F.count_if(is_("Dead")).alias("days_dead"), F.count_if(is_("QC_Fail")).alias("days_qc_fail"),
        F.min(F.when(is_("Unhealthy"), F.col("exp_day"))).alias("first_unhealthy_day"), F.min(F.when(is_("Dead"), F.col("exp_day"))).alias("first_dead_day"),
        F.max(F.when(is_("Alive"), F.col("exp_day"))).alias("last_alive_day"), F.max_by("status", "exp_day").alias("final_status"),
    )


def fly_days(bins: DataFrame, bin_minutes: int = 1, exclude_days: tuple[int, ...] = (), **options) -> DataFrame:
    """The chain from bins to final status of every fly-day."""
    used = bins.where(~F.col("exp_day").isin(*exclude_days)) if exclude_days else bins
    return irreversible(with_status(with_decline(daily_metrics(used, bin_minutes)), bin_minutes, **options))


def last_day_metrics(days: DataFrame) -> DataFrame:
    """Metrics of each fly's last day, clamped for fixed-point columns: the last value that isn't missing."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("exp_day")))
    clamp = lambda c, lo, hi: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))
    got = days.groupBy("fly_id").agg(*[last(c).alias(c) for c in ("total_activity", "longest_zero", "rel_activity", "no_startle")])
    return got.select(
        "fly_id", "total_activity", clamp(F.col("longest_zero") / 60.0, 0.0, 999.99).alias("longest_zero_hours"),
        clamp(F.col("rel_activity"), -99.999, 99.999).alias("rel_activity"), (~F.col("no_startle")).alias("has_startle"),
    )


def without_usable_readings(readings: DataFrame) -> DataFrame:
    """Flies that lack MT or Pn readings, or have none above 0."""
    most = lambda kind: F.max(F.when(F.col("reading_type") == kind, F.col("value")))
    got = readings.groupBy("fly_id", "monitor", "channel").agg(most("MT").alias("max_mt"), most("Pn").alias("max_pn"))
    return got.where((F.coalesce("max_mt", F.lit(0)) <= 0) | (F.coalesce("max_pn", F.lit(0)) <= 0))
