"""Schemas, column lists and default thresholds: fixed values that every part shares."""

from __future__ import annotations

from pyspark.sql import types as T

CHANNELS = [f"ch{i}" for i in range(1, 33)]
READING_TYPES = ["MT", "CT", "Pn"]
STATUSES = ["Alive", "Unhealthy", "Dead", "QC_Fail"]
META = ["genotype", "sex", "treatment"]
FLY = ["fly_id", "monitor", "channel", *META]

#: Raw monitor lines: tab separated, no header.
MONITOR = T.StructType(
    [T.StructField("id", T.IntegerType()), T.StructField("date", T.StringType()), T.StructField("time", T.StringType()), T.StructField("port", T.IntegerType())]
    + [T.StructField(f"unknown{i}", T.IntegerType()) for i in (1, 2, 3)]
    + [T.StructField("movement_type", T.StringType()), T.StructField("zero1", T.IntegerType()), T.StructField("zero2", T.IntegerType())]
    + [T.StructField(c, T.IntegerType()) for c in CHANNELS]
)
READINGS = T.StructType(
    [T.StructField("datetime", T.TimestampNTZType()), T.StructField("date", T.DateType()), T.StructField("time", T.StringType()), T.StructField("monitor", T.StringType())]
    + [T.StructField("channel", T.IntegerType()), T.StructField("reading", T.StringType()), T.StructField("value", T.IntegerType()), T.StructField("fly_id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in META]
    + [T.StructField("zt", T.IntegerType()), T.StructField("phase", T.StringType()), T.StructField("exp_day", T.IntegerType())]
)
RHYTHM_FEATURES = [
    "mesor_mean", "mesor_sd", "amplitude_mean", "amplitude_sd", "phase_mean", "phase_sd", "rhythmic_days", "periodogram_period_mean",
    "periodogram_period_sd", "periodogram_power_mean", "activity_onset_zt_mean", "activity_onset_zt_sd", "activity_offset_zt_mean",
    "activity_offset_zt_sd", "interdaily_stability",
]
SLEEP_FEATURES = [
    "total_sleep_mean", "day_sleep_mean", "night_sleep_mean", "total_bouts_mean", "day_bouts_mean", "night_bouts_mean", "mean_bout_mean",
    "max_bout_mean", "mean_day_bout_mean", "max_day_bout_mean", "mean_night_bout_mean", "max_night_bout_mean", "frag_bouts_per_hour_mean",
    "frag_bouts_per_min_sleep_mean", "mean_wake_bout_mean", "p_wake_mean", "p_doze_mean", "sleep_latency_mean", "waso_mean",
]
FEATURES = RHYTHM_FEATURES + SLEEP_FEATURES
Z_FEATURES = [f for f in FEATURES if f != "rhythmic_days"]
#: Means that are filled with the mean of their (genotype, sex, treatment) where they are missing.
IMPUTED = ["sleep_latency_mean", "waso_mean", "mesor_sd", "amplitude_sd", "phase_sd"]

#: Health thresholds: zero runs in minutes, activity in counts, index as a share of bins.
THRESHOLDS = {
    "A1": 12 * 60, "A2": 24 * 60, "activity_low": 50, "index_low": 0.02, "sleep_max": 1300, "sleep_bout": 12 * 60,
    "decline": 0.5, "death": 0.2, "missing_max": 0.10, "transition_minutes": 10,
}
LIGHTS_ON, LIGHTS_OFF, REF_DAY, EXCLUDE_DAYS = 9, 21, 4, (1, 7)
#: How features are named in tables for readers.
FEATURE_LABELS = {
    "mesor_mean": "Mesor",
    "mesor_sd": "Mesor variation",
    "amplitude_mean": "Amplitude",
    "amplitude_sd": "Amplitude variation",
    "phase_mean": "Phase",
    "phase_sd": "Phase variation",
    "periodogram_period_mean": "Period",
    "periodogram_period_sd": "Period variation",
    "periodogram_power_mean": "Rhythmicity",
    "activity_onset_zt_mean": "Activity onset",
    "activity_onset_zt_sd": "Activity onset variation",
    "activity_offset_zt_mean": "Activity offset",
    "activity_offset_zt_sd": "Activity offset variation",
    "interdaily_stability": "Interdaily stability",
    "total_sleep_mean": "Total sleep",
    "day_sleep_mean": "Daytime sleep",
    "night_sleep_mean": "Nighttime sleep",
    "total_bouts_mean": "Total sleep bouts",
    "day_bouts_mean": "Day sleep bouts",
    "night_bouts_mean": "Night sleep bouts",
    "mean_bout_mean": "Mean bout duration",
    "max_bout_mean": "Longest bout",
    "mean_day_bout_mean": "Mean day bout",
    "max_day_bout_mean": "Longest day bout",
    "mean_night_bout_mean": "Mean night bout",
    "max_night_bout_mean": "Longest night bout",
    "frag_bouts_per_hour_mean": "Sleep bouts/hour",
    "frag_bouts_per_min_sleep_mean": "Sleep interruption rate",
    "mean_wake_bout_mean": "Wake bout duration",
    "p_wake_mean": "P(wake)",
    "p_doze_mean": "P(doze)",
    "sleep_latency_mean": "Sleep latency",
    "waso_mean": "WASO",
}
