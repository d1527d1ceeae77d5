"""Zeitgeber time, phase and experiment day as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_hours(ts: Column) -> Column:
    """Hour of the day with its minutes as a fraction."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def zt(ts: Column, lights_on: float = 9) -> Column:
    """Whole hours since lights-on, 0 to 23."""
    return F.floor(F.pmod(clock_hours(ts) - F.lit(float(lights_on)), F.lit(24.0))).cast("int")


def phase(ts: Column, lights_on: float = 9) -> Column:
    """Light for the twelve hours from lights-on, else Dark."""
    return F.when(F.pmod(clock_hours(ts) - F.lit(float(lights_on)), F.lit(24.0)) < 12, "Light").otherwise("Dark")


def exp_day(ts: Column, start: str) -> Column:
    """Calendar days since the start date, counted from 1."""
    return (F.datediff(F.to_date(ts), F.lit(start).cast("date")) + 1).cast("int")


def near_transition(ts: Column, lights_on: float, lights_off: float, minutes: float) -> Column:
    """Whether the clock is within ``minutes`` of lights-on or lights-off, in double arithmetic and without a wrap at midnight."""
    h, w = clock_hours(ts), F.lit(minutes / 60.0)
    return (F.abs(h - F.lit(float(lights_on))) <= w) | (F.abs(h - F.lit(float(lights_off))) <= w)


def harmonic(zt: Column, period: float = 24) -> tuple[Column, Column]:
    """cos and sin of the angle of a time."""
    angle = F.lit(2 * math.pi) * zt / F.lit(float(period))
    return F.cos(angle), F.sin(angle)


def is_ok(c: Column) -> Column:
    """Whether a metadata value is present: not null, empty, 'na' or 'nan'."""
    return c.isNotNull() & ~F.lower(F.trim(c)).isin("", "na", "nan")


def fly_id(monitor: Column, channel: Column) -> Column:
    return F.concat(F.lit("M"), monitor, F.lit("_Ch"), F.lpad(channel.cast("string"), 2, "0"))


def fly_key(monitor: Column, channel: Column) -> Column:
    """Key of removal lists: monitor-chN, lower case, channel without leading zeros."""
    return F.lower(F.concat(monitor.cast("string"), F.lit("-ch"), F.regexp_replace(channel.cast("string"), "^ch", "")))
