"""Event tables as readings: a user is a fly, an event type a reading type.

view is MT, click is CT, every other type Pn. Dense bins hold a row for each fly and bin of the period, 0 where nothing
happened. Events are dealt by fly and counted there; each fly then adds its zero rows, so that only events are shuffled, and what groups
or windows by fly_id and more finds its rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp

#: The period of the event table.
START, DAYS = "2024-01-01", 30
#: Events of a partition of dense bins, of which there are some ten times as many: partitions grow in number, not in size.
PART_EVENTS = 50_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def with_fly(df: DataFrame) -> DataFrame:
    """Fly columns from user_id. A fly_id that is there stays, and with it what Spark knows of how rows are dealt."""
    u = F.col("user_id")
    monitor, channel = F.expr("user_id div 32").cast("string"), (u % 32 + 1).cast("int")
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    named = {} if "fly_id" in df.columns else {"fly_id": tp.fly_id(monitor, channel)}
    return df.withColumns({
        "monitor": monitor, "channel": channel, **named,
        "genotype": pick(["Iso", "Fmn", "Rye", "SSS"], u % 4), "sex": pick(["Female", "Male"], F.expr("user_id div 4") % 2),
        "treatment": pick(["VEH", "2mM Arg", "8mM Arg"], u % 3),
    })


def readings(spark: SparkSession, sf_dir: str, users: int = 1) -> DataFrame:
    """One row for each event: fly columns, datetime, date, zt, phase, exp_day, reading_type, value; ``users`` users are one fly."""
    e = with_fly(events(spark, sf_dir).select("event_id", F.expr(f"user_id div {users}").alias("user_id"), F.col("ts").alias("datetime"), "event_type", "value"))
    kind = F.when(F.col("event_type") == "view", "MT").when(F.col("event_type") == "click", "CT").otherwise("Pn")
    t = F.col("datetime")
    return e.withColumns({"reading_type": kind, "date": F.to_date(t), "zt": tp.zt(t), "phase": tp.phase(t), "exp_day": tp.exp_day(t, START)})


def dense(spark: SparkSession, sf_dir: str, minutes: int = 60, users: int = 1, missing: bool = False) -> DataFrame:
    """Fly columns, datetime of the bin, n (events), value (their sum), date, zt, exp_day for every bin of the period.

    ``users`` consecutive users are one fly; with ``missing``, n is null in bins in which an error was read.
    """
    bad = F.col("event_type") == "error" if missing else F.lit(False)
    e = events(spark, sf_dir)
    parts = max(spark.sparkContext.defaultParallelism, -(-e.count() // PART_EVENTS))
    e = e.select(F.expr(f"user_id div {users}").alias("user_id"), "ts", "value", bad.alias("bad"))
    since = F.floor(F.expr(f"timestampdiff(MINUTE, timestamp_ntz'{START}', ts)") / minutes).cast("int") * minutes
    at = F.expr(f"timestamp_ntz'{START}'") + F.make_dt_interval(mins=since)
    seen = with_fly(e).select("fly_id", "user_id", at.alias("datetime"), F.lit(1).cast("long").alias("one"), "value", "bad")
    # from here on all rows of a fly are in one partition, and no bin is shuffled
    key, sums = ["fly_id", "user_id"], [F.sum("one").alias("one"), F.sum("value").alias("value"), F.bool_or("bad").alias("bad")]
    some = seen.repartition(parts, "fly_id").groupBy(*key, "datetime").agg(*sums)
    end = F.expr(f"timestamp_ntz'{START}' + interval {DAYS} days - interval {minutes} minutes")
    bins = F.sequence(F.expr(f"timestamp_ntz'{START}'"), end, F.expr(f"interval {minutes} minutes"))
    row = lambda *v: F.struct(*[c.alias(k) for c, k in zip(v, ("datetime", "one", "value", "bad"), strict=True)])
    empty = F.transform(bins, lambda b: row(b, F.lit(0).cast("long"), F.lit(0.0), F.lit(False)))
    flies = some.groupBy(*key).agg(F.collect_list(row(*map(F.col, ("datetime", "one", "value", "bad")))).alias("_seen"))
    both = flies.select(*key, F.inline(F.concat("_seen", empty))).groupBy(*key, "datetime").agg(*sums)
    t = F.col("datetime")
    both = both.select("user_id", "datetime", F.when(~F.col("bad"), F.col("one")).alias("n"), "value", "fly_id")
    return with_fly(both).withColumns({"date": F.to_date(t), "zt": tp.zt(t), "exp_day": tp.exp_day(t, START)})
