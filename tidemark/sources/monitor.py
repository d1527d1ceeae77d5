"""Raw monitor files, metadata files and the line filter: text in, rows out."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.schemas import CHANNELS, MONITOR, READING_TYPES

STAMP = "d MMM yy HH:mm:ss"


def parse_load_date(text: str) -> dt.date:
    """A date like 06/20/25."""
    return dt.datetime.strptime(text, "%m/%d/%y").date()


def monitor_number(name: str) -> str:
    """The digits of a monitor's name or path."""
    return "".join(c for c in name.rsplit("/", 1)[-1] if c.isdigit())


def monitor_id(file_name: Column) -> Column:
    """What stands between Monitor and .txt in a file name; other names give their digits."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"^Monitor(.*)\.txt$", 1), F.lit("")), F.regexp_replace(file_name, r"\D", ""))


def read_lines(spark: SparkSession, path: str, pattern: str = "Monitor*.txt") -> DataFrame:
    """(value, monitor) of each line of the files of a folder, in one scan of all files."""
    return spark.read.option("pathGlobFilter", pattern).text(path).select("value", monitor_id(F.col("_metadata.file_name")).alias("monitor"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (value, monitor) as 42 typed columns and datetime; lines of another width or without a time are left out."""
    parts = F.split("value", "\t", -1)
    cols = [F.try_element_at(parts, F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(MONITOR.fields)]
    wide = lines.where(F.size(parts) == len(MONITOR.fields)).select("monitor", *cols)
    stamp = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit(STAMP)).cast("timestamp_ntz")
    return wide.withColumn("datetime", stamp).where(F.col("datetime").isNotNull())


def to_readings(wide: DataFrame, active_only: bool = True) -> DataFrame:
    """(monitor, datetime, channel, reading_type, value) with a row for each of MT, CT and Pn, 0 where a type is missing.

    Times at which a channel's three values are all 0 are left out. A type that repeats at a time counts with its first value.
    """
    long = wide.where(F.col("movement_type").isin(READING_TYPES)).unpivot(["monitor", "id", "datetime", "movement_type"], CHANNELS, "channel", "value")
    each = long.groupBy("monitor", "datetime", F.regexp_replace("channel", "^ch", "").cast("int").alias("channel")).pivot("movement_type", READING_TYPES).agg(F.min_by("value", "id"))
    each = each.na.fill(0, READING_TYPES)
    if active_only:
        each = each.where("MT > 0 or CT > 0 or Pn > 0")
    return each.unpivot(["monitor", "datetime", "channel"], READING_TYPES, "reading_type", "value")


def parse_metadata(lines: DataFrame) -> DataFrame:
    """(monitor, channel, fly_id, genotype, sex, treatment) of lines ``value``: at least four words, the treatment may have spaces.

    Blank lines, comments, the header and rows whose genotype is missing are left out.
    """
    w = F.split(F.trim("value"), r"\s+")
    channel = F.regexp_replace(w[1], "(?i)^ch", "").try_cast("int")
    rows = lines.where((F.size(w) >= 4) & ~F.startswith(F.trim("value"), F.lit("#")) & (F.lower(w[0]) != "monitor"))
    out = rows.select(w[0].alias("monitor"), channel.alias("channel"), w[2].alias("genotype"), w[3].alias("sex"), F.nullif(F.array_join(F.slice(w, F.lit(5), F.greatest(F.size(w) - 4, F.lit(0))), " "), F.lit("")).alias("treatment"))
    out = out.where(tp.is_ok(F.col("genotype")) & F.col("channel").isNotNull())
    return out.withColumn("fly_id", tp.fly_id(F.col("monitor"), F.col("channel")))


def filter_lines(lines: DataFrame, load: dt.date, days: int, offset: int, hour: int = 9) -> DataFrame:
    """Lines of the half-open window [load + offset at ``hour``, ``days`` later), byte for byte; lines without a time are left out."""
    start = dt.datetime.combine(load + dt.timedelta(days=offset), dt.time(hour))
    p = F.split("value", "\t")
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.get(p, F.lit(1)), F.get(p, F.lit(2))), F.lit(STAMP)).cast("timestamp_ntz")
    inside = (stamp >= F.lit(str(start)).cast("timestamp_ntz")) & (stamp < F.lit(str(start + dt.timedelta(days=days))).cast("timestamp_ntz"))
    return lines.where((F.size(p) >= 3) & F.coalesce(inside, F.lit(False)))


def prepare(readings: DataFrame, metadata: DataFrame, start: str, lights_on: float = 9, ends: tuple[str, str] | None = None) -> DataFrame:
    """Readings joined with fly metadata, with date, time, zt, phase and exp_day, on request within two dates (inclusive).

    Metadata has a row for each channel in use, some tens for each monitor; Spark broadcasts it by its size if that is small.
    """
    both = readings.join(metadata, ["monitor", "channel"])
    t = F.col("datetime")
    out = both.withColumns({"date": F.to_date(t), "time": F.date_format(t, "HH:mm:ss"), "zt": tp.zt(t, lights_on), "phase": tp.phase(t, lights_on), "exp_day": tp.exp_day(t, start)})
    return out.where(F.col("date").between(*ends)) if ends else out


def removal_criteria(text: str) -> dict[str, list[int]]:
    """A JSON map of fly keys to days, keys lower case with unpadded channels."""
    import json

    return {re.sub(r"-ch0*(\d)", r"-ch\1", k.lower()): [int(d) for d in v] for k, v in json.loads(text).items()}
