"""Streaming forms of the batch operators that have one: bins, hourly totals, trailing days, bouts by gaps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def hourly_totals(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sum of value for each fly and hour, final once the watermark has passed."""
    return stream.withWatermark("datetime", late).groupBy("fly_id", F.window("datetime", "1 hour").alias("w")).agg(F.sum("value").alias("total")).select("fly_id", F.col("w.start").alias("hour"), "total")


def bins(stream: DataFrame, late: str = "10 minutes", minutes: int = 5) -> DataFrame:
    """MT sum and Pn variance for each fly and bin; no variance is 0."""
    of = lambda kind: F.when(F.col("reading_type") == kind, F.col("value"))
    got = stream.withWatermark("datetime", late).groupBy("fly_id", F.window("datetime", f"{minutes} minutes").alias("w"))
    return got.agg(F.sum(of("MT")).alias("mt_sum"), F.coalesce(F.var_samp(of("Pn")), F.lit(0.0)).alias("pn_var")).select("fly_id", F.col("w.start").alias("bin_start"), "mt_sum", "pn_var")


def trailing_day(stream: DataFrame, late: str = "1 hour", hour: int = 9) -> DataFrame:
    """Sum of value over each day that runs from ``hour`` to ``hour``."""
    w = F.window("datetime", "24 hours", "24 hours", f"{hour} hours").alias("w")
    return stream.withWatermark("datetime", late).groupBy("fly_id", w).agg(F.sum("value").alias("total")).select("fly_id", F.col("w.end").alias("day_end"), "total")


def gap_bouts(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bouts of events at most ``gap`` apart."""
    got = stream.withWatermark("datetime", late).groupBy("fly_id", F.session_window("datetime", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("fly_id", F.col("w.start").alias("start"), F.col("w.end").alias("closed"), "n")


class _Death(StatefulProcessor):
    """A fly's first dead day, and the status that each of its days went out with."""

    def init(self, handle) -> None:
        self.since = handle.getValueState("since", "exp_day int")
        self.sent = handle.getMapState("sent", "exp_day int", "status string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:  # noqa: N802
        new = {r["exp_day"]: r["status"] for r in rows}
        before = self.since.get()[0] if self.since.exists() else None
        dead = [d for d, status in new.items() if status == "Dead"] + ([] if before is None else [before])
        since = min(dead, default=None)
        if since is not None and since != before:
            self.since.update((since,))
            for (day,), (status,) in list(self.sent.iterator()):
                if day >= since and status != "Dead" and day not in new:
                    new[day] = "Dead"
        for day, status in sorted(new.items()):
            final = "Dead" if since is not None and day >= since else status
            if not self.sent.containsKey((day,)) or self.sent.getValue((day,))[0] != final:
                self.sent.updateValue((day,), (final,))
                yield Row(fly_id=key[0], exp_day=day, status=final)

    def close(self) -> None:
        pass


def irreversible(days: DataFrame) -> DataFrame:
    """Fly-days (fly_id, exp_day, status) in update mode, Dead from a fly's first dead day on.

    Days that went out as something else go out again when an earlier death arrives, and when they arrive again with another
    status, so that the last row of each (fly_id, exp_day) is what the batch form gives. A fly's state is a number and a row for each of
    its days, of which an experiment has a few; it doesn't expire. The session's state store is set to RocksDB, which holds such
    states, unless another one but the default was chosen.
    """
    conf, name = days.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in conf.get(name, "HDFSBacked"):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return days.groupBy("fly_id").transformWithState(_Death(), "fly_id string, exp_day int, status string", "update", "None")
