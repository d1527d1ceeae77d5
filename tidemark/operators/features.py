"""The feature table and its cleaning: removal, outliers, imputation, z-scores, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.operators import rhythm, sleep
from tidemark.operators.lineage import cut
from tidemark.schemas import EXCLUDE_DAYS, FLY, IMPUTED, META, Z_FEATURES


def feature_table(bins: DataFrame, bin_minutes: float = 1, threshold: float = 5, exclude_days: tuple[int, ...] = EXCLUDE_DAYS, with_periodogram: bool = True) -> DataFrame:
    """Rhythm and sleep features of each fly that has both; rows without usable metadata take no part in rhythm."""
    used = bins.where(~F.col("exp_day").isin(*exclude_days)) if exclude_days else bins
    valid = used
    for c in META:
        valid = valid.where(tp.is_ok(F.col(c)))
    left = rhythm.rhythm_features(rhythm.hourly_totals(valid), with_periodogram)
    right = sleep.sleep_features(sleep.sleep_daily(used, bin_minutes, threshold))
    return left.join(right, FLY)


def usable_rows(readings: DataFrame) -> DataFrame:
    """Readings with a numeric zt, a day and all metadata; zt becomes a number."""
    return readings.withColumn("zt", F.col("zt").try_cast("int")).dropna(subset=[*META, "zt", "exp_day"])


def is_problem(with_doze: bool = False) -> Column:
    """Whether a fly has no sleep or no bouts (null or 0), or on request no P_doze."""
    names = ["total_sleep_mean", "total_bouts_mean"] + (["p_doze_mean"] if with_doze else [])
    bad = F.lit(False)
    for n in names:
        bad = bad | (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) == 0)
    return bad


def problem_flies(features: DataFrame, with_doze: bool = False) -> DataFrame:
    return features.where(is_problem(with_doze))


def iqr_bounds(features: DataFrame, column: str = "total_sleep_mean", multiplier: float = 1.5) -> DataFrame:
    """Quartiles and bounds of a column for each (genotype, sex, treatment)."""
    q = features.groupBy(*META).agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select(*META, "q1", "q3", iqr.alias("iqr"), (F.col("q1") - multiplier * iqr).alias("lower"), (F.col("q3") + multiplier * iqr).alias("upper"))


def with_outlier(features: DataFrame, column: str = "total_sleep_mean", multiplier: float = 1.5) -> DataFrame:
    """Features with is_outlier; missing values are no outliers. Quartiles are windows, so features are computed once."""
    w = Window.partitionBy(*META)
    q1, q3 = (F.percentile(column, F.lit(p)).over(w) for p in (0.25, 0.75))
    df = features.withColumn("_q1", q1).withColumn("_q3", q3)
    reach = multiplier * (F.col("_q3") - F.col("_q1"))
    out = (F.col(column) < F.col("_q1") - reach) | (F.col(column) > F.col("_q3") + reach)
    return df.withColumn("is_outlier", F.coalesce(out, F.lit(False))).drop("_q1", "_q3")


def outlier_summary(features: DataFrame, **options) -> DataFrame:
    got = with_outlier(features, **options).groupBy(*META).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"))
    return got.withColumn("percent", F.bround(F.col("n_outliers") * 100 / F.col("n"), 1))


def impute(features: DataFrame, columns: list[str] = IMPUTED) -> DataFrame:
    """Missing values become the mean of their (genotype, sex, treatment); a group without values stays missing."""
    w = Window.partitionBy(*META)
    return features.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in columns})


def z_scores(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """FLY columns and <feature>_z: distance from the mean in sample deviations; null where the deviation is 0.

    The features, a row for each fly, are written once; means and deviations come from one aggregation over them, a single
    row that is joined back.
    """
    features = cut(features)
    names = [c for c in (columns or Z_FEATURES) if c in features.columns]
    stats = features.agg(*[f(c).alias(f"_{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    wide = features.join(F.broadcast(stats))
    return wide.select(*FLY, *[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{c}_z") for c in names])


def diagnostics(features: DataFrame) -> DataFrame:
    """Missing values of each column: column, n_missing, n_rows; one aggregation, then one row for each column."""
    missing = lambda c, t: F.count_if(F.col(c).isNull() | (F.isnan(c) if t == "double" else F.lit(False)))
    one = features.agg(F.count(F.lit(1)).alias("n_rows"), *[missing(c, t).alias(c) for c, t in features.dtypes])
    return one.unpivot("n_rows", [c for c, _ in features.dtypes], "column", "n_missing").select("column", "n_missing", "n_rows")


def rows_with_missing(features: DataFrame) -> DataFrame:
    """(n_missing, n_rows): rows in which any column is missing."""
    gap = F.lit(False)
    for c, t in features.dtypes:
        gap = gap | F.col(c).isNull() | (F.isnan(c) if t == "double" else F.lit(False))
    return features.agg(F.count_if(gap).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))


def clean(features: DataFrame, multiplier: float = 1.5, with_doze: bool = False) -> DataFrame:
    """Without problem flies and outliers, and imputed."""
    kept = with_outlier(features.where(~is_problem(with_doze)), multiplier=multiplier).where(~F.col("is_outlier"))
    return impute(kept.drop("is_outlier"), [c for c in IMPUTED if c in kept.columns])


def removal_stage(flies: list[str], days: dict[str, list[int]], genotypes: list[str], sexes: list[str], treatments: list[str], statuses: list[str]) -> Column:
    """Which rule removes a row, the first of: status, fly, day, genotype, sex, treatment; null if none. Needs final_status."""
    low = lambda names: [n.lower() for n in names]
    key = tp.fly_key(F.col("monitor"), F.col("channel"))
    stage = F.when(F.lower("final_status").isin(low(statuses)), "status").when(key.isin(low(flies)), "fly")
    for k, v in days.items():
        stage = stage.when((key == k.lower()) & F.col("exp_day").isin(v), "day")
    return stage.when(F.lower("genotype").isin(low(genotypes)), "genotype").when(F.lower("sex").isin(low(sexes)), "sex").when(F.lower("treatment").isin(low(treatments)), "treatment")


def remove_flies(readings: DataFrame, report: DataFrame, flies=(), days=None, genotypes=(), sexes=(), treatments=(), statuses=("Dead",)) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rows removed by stage). Rules are constants, so a row is tested once and nothing but status is joined."""
    status = report.select("fly_id", "final_status")
    tagged = readings.join(status, "fly_id", "left").withColumn("_stage", removal_stage(list(flies), days or {}, list(genotypes), list(sexes), list(treatments), list(statuses)))
    counts = tagged.where("_stage is not null").groupBy(F.col("_stage").alias("stage")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("fly_id").alias("n_flies"))
    return tagged.where("_stage is null").drop("_stage", "final_status"), counts


