"""Circadian rhythm of fly-days: hourly totals, cosinor, periodogram, onset and offset, interdaily stability."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.schemas import FLY

DAY = [*FLY, "exp_day"]


def hourly_totals(mt: DataFrame, value: str = "value") -> DataFrame:
    """Sum of movement for each fly, day and zeitgeber hour; metadata travels in the key."""
    return mt.groupBy(*DAY, "zt").agg(F.coalesce(F.sum(value), F.lit(0)).alias("hourly_mt"))


def cosinor(hourly: DataFrame, period: float = 24) -> DataFrame:
    """Least-squares fit of mesor + a cos + b sin to each day, in one aggregation and closed form.

    phase is (period * atan2(-b, a) / 2 pi, to 9 digits) mod period, so that it never reads a whole period. p is the tail of F with 2 and n - 3 degrees of freedom,
    (1 + 2F/m)^(-m/2). A flat day has phase 0. Fewer than 3 hours: all null; 3 hours or no variance: p null; a perfect fit: p 0.
    """
    c, s = tp.harmonic(F.col("zt"), period)
    y = F.col("hourly_mt").cast("double")
    parts = {"C": c, "S": s, "CC": c * c, "SS": s * s, "CS": c * s, "Y": y, "YC": y * c, "YS": y * s, "YY": y * y}
    sums = hourly.groupBy(*DAY).agg(F.count("hourly_mt").alias("n"), F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(f"_{k}") for k, v in parts.items()])
    v = lambda k: F.col(f"_{k}")
    n = F.col("n")
    centred = {"cc": v("CC") - v("C") * v("C") / n, "ss": v("SS") - v("S") * v("S") / n, "cs": v("CS") - v("C") * v("S") / n}
    centred |= {"yc": v("YC") - v("Y") * v("C") / n, "ys": v("YS") - v("Y") * v("S") / n, "sst": v("YY") - v("Y") * v("Y") / n}
    fit = sums.where(n > 0).withColumns(centred).withColumn("det", F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"))
    fit = fit.withColumn("a", F.try_divide(F.col("yc") * F.col("ss") - F.col("ys") * F.col("cs"), F.col("det")))
    fit = fit.withColumn("b", F.try_divide(F.col("ys") * F.col("cc") - F.col("yc") * F.col("cs"), F.col("det")))
    fit = fit.withColumn("sse", F.greatest(F.col("sst") - F.col("a") * F.col("yc") - F.col("b") * F.col("ys"), F.lit(0.0)))
    m, turn = n - 3, F.lit(2 * math.pi)
    f = ((F.col("sst") - F.col("sse")) / 2) / (F.col("sse") / m)
    tail = F.pow(1 + 2 * f / m, -m / 2.0)
    p = F.when((m <= 0) | (F.col("sst") <= 1e-9), None).when(F.col("sse") <= 1e-12 * F.col("sst"), 0.0).otherwise(tail)
    enough = (n >= 3) & (n == F.col("rows"))
    out = {
        "mesor": (v("Y") - F.col("a") * v("C") - F.col("b") * v("S")) / n, "amplitude": F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")),
        "phase": F.when(F.hypot("a", "b") < 1e-9, 0.0).otherwise(F.pmod(F.round(F.lit(float(period)) * F.atan2(-F.col("b"), F.col("a")) / turn, 9), F.lit(float(period)))), "p_value": p,
    }
    return fit.select(*DAY, *[F.when(enough, c).alias(k) for k, c in out.items()])


def periodogram(hourly: DataFrame, low: float = 18.0, high: float = 30.0, steps: int = 1000) -> DataFrame:
    """Normalised Lomb-Scargle power of each day over ``steps`` periods: the first best period and its power.

    Times are angles of the 24-hour day while periods are taken in hours, as in the pipeline that this matches. Null for fewer
    than 3 hours, missing values, or no variance. Python, batched over days: the grid times the hours of a day have no SQL form
    that doesn't make a row for each. Days with the same hours are one product with the same sines, which are kept.
    """
    freq = 2 * np.pi / np.linspace(low, high, steps)

    def waves(hours: tuple) -> tuple[np.ndarray, np.ndarray]:
        wt = np.outer(freq, np.asarray(hours, float) * 2 * np.pi / 24)
        tau = np.arctan2(np.sin(2 * wt).sum(1), np.cos(2 * wt).sum(1)) / 2
        both = np.cos(wt - tau[:, None]), np.sin(wt - tau[:, None])
        return tuple(m / np.sqrt(np.maximum((m * m).sum(1, keepdims=True), 1e-300)) for m in both)

    def best(frames):
        known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in frames:
            at, power = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            alike: dict[tuple, list[int]] = {}
            for i, zts in enumerate(pdf["zts"]):
                alike.setdefault(tuple(zts), []).append(i)
            for hours, rows in alike.items():
                y = np.array([[np.nan if v is None else v for v in pdf["ys"].iloc[i]] for i in rows], float)
                fine = ~np.isnan(y).any(1) & (np.var(y, axis=1) != 0) if len(hours) >= 3 else np.zeros(len(rows), bool)
                if not fine.any():
                    continue
                if len(known) > 64:
                    known.clear()
                c, s = known.setdefault(hours, known.get(hours) or waves(hours))
                y = y[fine] - y[fine].mean(1, keepdims=True)
                p = ((y @ c.T) ** 2 + (y @ s.T) ** 2) / (y * y).sum(1, keepdims=True)
                where = np.asarray(rows)[fine]
                at[where], power[where] = 2 * np.pi / freq[p.argmax(1)], p.max(1)
            some = ~np.isnan(power)
            yield pdf.drop(columns=["zts", "ys"]).assign(**{f"periodogram_{k}": pd.arrays.FloatingArray(np.where(some, v, 0.0), ~some) for k, v in (("period", at), ("power", power))})

    row = F.array_sort(F.collect_list(F.struct("zt", F.col("hourly_mt").cast("double").alias("y"))))
    days = hourly.groupBy(*DAY).agg(row.alias("r")).select(*DAY, F.col("r.zt").alias("zts"), F.col("r.y").alias("ys"))
    fields = ", ".join(f"{c} {t}" for c, t in days.dtypes if c not in ("zts", "ys"))
    return days.mapInPandas(best, f"{fields}, periodogram_period double, periodogram_power double")


def onset_offset(hourly: DataFrame, sds: float = 1.0) -> DataFrame:
    """Activity onset and offset of each day on its three-hour centred mean.

    Threshold: 10th percentile plus ``sds`` population deviations. Onset: the first hour from the minimum on that starts two
    hours above it. Offset: the last hour above it that two hours at or below follow. A mean within 5e-10 of the threshold counts as
    at it, and minima are the same to nine digits: sums taken in another order decide neither.
    """
    by_zt = Window.partitionBy(*DAY).orderBy("zt")
    whole = Window.partitionBy(*DAY)
    y = F.col("hourly_mt").cast("double")
    df = hourly.withColumn("y", y).withColumn("smooth", F.avg("y").over(by_zt.rowsBetween(-1, 1))).withColumn("i", F.row_number().over(by_zt))
    df = df.withColumn("threshold", F.percentile("smooth", F.lit(0.1)).over(whole) + F.lit(float(sds)) * F.stddev_pop("smooth").over(whole))
    df = df.withColumn("above", F.round(F.col("smooth") - F.col("threshold"), 9) > 0)
    df = df.withColumn("next1", F.lead("above", 1).over(by_zt)).withColumn("next2", F.lead("above", 2).over(by_zt))
    df = df.withColumn("low", F.min(F.struct(F.round("smooth", 9), "i")).over(whole)["i"])
    on = (F.col("i") >= F.col("low")) & F.col("above") & F.col("next1")
    off = F.col("above") & ~F.col("next1") & ~F.col("next2")
    got = df.groupBy(*DAY).agg(F.count("y").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.when(on, F.col("zt"))).alias("on"), F.max(F.when(off, F.col("zt"))).alias("off"))
    good = (F.col("n") >= 3) & (F.col("n") == F.col("rows"))
    return got.select(*DAY, F.when(good, F.col("on")).alias("onset_zt"), F.when(good, F.col("off")).alias("offset_zt"))


def interdaily_stability(hourly: DataFrame) -> DataFrame:
    """n * sum of squares of hour means / (hours * total sum of squares) for each fly, from two aggregations."""
    x = F.col("hourly_mt").cast("double")
    hours = hourly.groupBy(*FLY, "zt").agg(F.count(x).alias("k"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.avg(x).alias("m"))
    fly = hours.groupBy(*FLY).agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("p"), F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("qm"))
    g = F.col("s") / F.col("n")
    between = F.col("qm") - 2 * g * F.col("sm") + F.col("p") * g * g
    total = F.col("q") - F.col("n") * g * g
    return fly.select(*FLY, F.when((F.col("n") >= 2) & (total > 1e-9), F.col("n") * between / (F.col("p") * total)).alias("interdaily_stability"))


def rhythm_features(hourly: DataFrame, with_periodogram: bool = True) -> DataFrame:
    """The rhythm half of the feature table: one row for each fly."""
    days = cosinor(hourly).join(onset_offset(hourly).select("fly_id", "exp_day", "onset_zt", "offset_zt"), ["fly_id", "exp_day"], "left")
    if with_periodogram:
        days = days.join(periodogram(hourly).select("fly_id", "exp_day", "periodogram_period", "periodogram_power"), ["fly_id", "exp_day"], "left")
    both = lambda c, name: [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd")]
    cols = [*both("mesor", "mesor"), *both("amplitude", "amplitude"), *both("phase", "phase"), F.count_if(F.col("p_value") < 0.05).alias("rhythmic_days")]
    if with_periodogram:
        cols += [*both("periodogram_period", "periodogram_period"), F.avg("periodogram_power").alias("periodogram_power_mean")]
    cols += [*both("onset_zt", "activity_onset_zt"), *both("offset_zt", "activity_offset_zt")]
    stable = interdaily_stability(hourly).select("fly_id", "interdaily_stability")
    return days.groupBy(*FLY).agg(*cols).join(stable, "fly_id", "left")
