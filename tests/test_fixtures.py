"""Values worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.functions import timeparts as tp
from tidemark.operators import features, health, ml, rhythm, runs, sleep, states, stats
from tidemark.sources import monitor, store

FLY = ("M1_Ch01", "1", 1, "Iso", "Female", "VEH")
FLY_DDL = "fly_id string, monitor string, channel int, genotype string, sex string, treatment string"


def bins(spark, counts, start="2024-01-02 09:00:00", minutes=1):
    t0 = dt.datetime.fromisoformat(start)
    rows = [(*FLY, t0 + dt.timedelta(minutes=minutes * i), c) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, f"{FLY_DDL}, datetime timestamp_ntz, n int")
    t = F.col("datetime")
    return df.withColumns({"date": F.to_date(t), "zt": tp.zt(t), "exp_day": tp.exp_day(t, "2024-01-02")})


def test_run_lengths(spark):
    got = runs.run_lengths(bins(spark, [0, 0, 1, 0, 0, 0]), ["fly_id"], "datetime", F.col("n") == 0).orderBy("run_id").collect()
    assert [(r.flag, r.length) for r in got] == [(True, 2), (False, 1), (True, 3)]


def test_daily_metrics(spark):
    r = health.daily_metrics(bins(spark, [0, 0, 1, 0, 0, 0])).first()
    assert (r.total_activity, r.longest_zero, r.total_sleep, r.missing_frac) == (1, 3, 0, 0) and r.activity_index == pytest.approx(1 / 6)
    assert r.transition_counts == 1 and not r.no_startle


def test_sleep_bouts(spark):
    r = sleep.sleep_daily(bins(spark, [1] * 4 + [0] * 6 + [1] * 2 + [0] * 5)).first()
    assert (r.total_bouts, r.total_sleep, r.mean_bout, r.max_bout, r.mean_wake_bout) == (2, 11, 5.5, 6, 3)
    assert r.p_wake == pytest.approx(1 / 11) and r.p_doze == pytest.approx(2 / 6)
    assert r.sleep_latency is None and r.waso is None and r.night_bouts == 0


def test_latency_in_the_dark(spark):
    r = sleep.sleep_daily(bins(spark, [1, 0, 1] + [0] * 5 + [1, 1], start="2024-01-02 21:00:00")).first()
    assert (r.sleep_latency, r.waso) == (3, 2)


def test_short_quiet_runs_are_awake(spark):
    r = sleep.sleep_daily(bins(spark, [0, 0, 1, 0, 0])).first()
    assert (r.total_sleep, r.total_bouts, r.mean_wake_bout, r.p_wake, r.p_doze) == (0, 0, 5, None, 0)


def test_zt_and_phase(spark):
    got = spark.createDataFrame([(f"2024-01-02 {h}:00",) for h in ("08:59", "09:00", "20:59", "21:00")], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    rows = got.select(tp.zt(F.col("t")).alias("z"), tp.phase(F.col("t")).alias("p")).collect()
    assert [(r.z, r.p) for r in rows] == [(23, "Dark"), (0, "Light"), (11, "Light"), (12, "Dark")]


def test_startle_edges(spark):
    got = spark.createDataFrame([(f"2024-01-02 {h}:00",) for h in ("08:50", "09:10", "20:50", "21:10")], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in got.select(tp.near_transition(F.col("t"), 9, 21, 10)).collect()] == [True, True, False, False]


def hourly(spark, days):
    rows = [(*FLY, d + 1, z, float(y)) for d, day in enumerate(days) for z, y in enumerate(day)]
    return spark.createDataFrame(rows, f"{FLY_DDL}, exp_day int, zt int, hourly_mt double")


WAVE = [10 + 3 * math.cos(2 * math.pi * z / 24) + 4 * math.sin(2 * math.pi * z / 24) for z in range(24)]


def test_cosinor(spark):
    r = rhythm.cosinor(hourly(spark, [WAVE])).first()
    assert r.mesor == pytest.approx(10) and r.amplitude == pytest.approx(5) and r.p_value == pytest.approx(0, abs=1e-9)
    assert r.phase == pytest.approx((24 * math.atan2(-4, 3) / (2 * math.pi)) % 24)
    three, two, flat = (rhythm.cosinor(hourly(spark, [d])).first() for d in (WAVE[:3], WAVE[:2], [5] * 24))
    assert three.mesor is not None and three.p_value is None and two.mesor is None and flat.p_value is None and flat.phase == 0


def test_periodogram_against_a_loop(spark):
    day = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    r = rhythm.periodogram(hourly(spark, [day])).first()
    y, t, best = np.array(day, float) - np.mean(day), np.arange(12) * 2 * math.pi / 24, (-1, 0)
    for p in np.linspace(18, 30, 1000):
        w = 2 * math.pi / p
        tau = math.atan2(sum(np.sin(2 * w * t)), sum(np.cos(2 * w * t))) / (2 * w)
        c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
        best = max(best, ((sum(y * c) ** 2 / sum(c * c) + sum(y * s) ** 2 / sum(s * s)) / sum(y * y), p), key=lambda b: b[0])
    assert r.periodogram_power == pytest.approx(best[0]) and r.periodogram_period == pytest.approx(best[1])
    assert rhythm.periodogram(hourly(spark, [[2, 2, 2]])).first().periodogram_power is None


def test_interdaily_stability(spark):
    assert rhythm.interdaily_stability(hourly(spark, [WAVE] * 3)).first().interdaily_stability == pytest.approx(1)


def test_irreversible_death(spark):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(["Alive", "Dead", "Alive", "Unhealthy"])], "fly_id string, exp_day int, status string")
    assert [r.status for r in health.irreversible(df).orderBy("exp_day").collect()] == ["Alive", "Dead", "Dead", "Dead"]


def test_decline_of_a_zero_reference(spark):
    df = spark.createDataFrame([("a", 4, 0), ("a", 5, 9), ("b", 5, 1), ("c", 4, 10), ("c", 5, 1), ("c", 6, 4)], "fly_id string, exp_day int, total_activity long")
    got = {(r.fly_id, r.exp_day): (r.rel_activity, r.decline_status) for r in health.with_decline(df).collect()}
    assert got["a", 5] == (None, "Stable") and got["b", 5] == (None, "No Reference")
    assert got["c", 5][1] == "Dead (by decline)" and got["c", 6][1] == "Unhealthy (by decline)"


def test_iqr(spark):
    df = spark.createDataFrame([("g", "s", "t", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)], "genotype string, sex string, treatment string, total_sleep_mean double")
    b = features.iqr_bounds(df).first()
    assert (b.q1, b.q3, b.lower, b.upper) == (2, 4, -1, 7)
    assert [r.total_sleep_mean for r in features.with_outlier(df).where("is_outlier").collect()] == [100]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "feature string, p double")
    assert [round(r.p_adj, 4) for r in stats.benjamini_hochberg(df, [], "p", "feature").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_cliffs_delta(spark):
    df = spark.createDataFrame([("f", "x", v) for v in (1.0, 2.0, 3.0)] + [("f", "y", v) for v in (2.0, 3.0, 4.0)], "feature string, g string, value double")
    r = stats.cliffs_delta(df, "g").first()
    assert r.delta == pytest.approx(-5 / 9) and r.magnitude == "large"


def test_tails():
    assert tails.f_tail(3, 2, 10) == pytest.approx(1.6**-5) and tails.chi2_tail(5, 2) == pytest.approx(math.exp(-2.5))
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6) and tails.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503)
    assert tails.studentized_range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    w, p = tails.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.003) and p == pytest.approx(0.0067, abs=2e-4)


def test_monitor_lines(spark):
    def line(day, time, kind, values):
        return "\t".join(["1", day, time, "7", "0", "0", "0", kind, "0", "0", *map(str, values + [0] * (32 - len(values)))])

    texts = [line("20 Jun 25", "09:00:00", "MT", [3]), line("20 Jun 25", "09:00:00", "Pn", [0, 2]), line("1 Jul 25", "09:00:00", "XX", [9]), "junk", "", line("bad", "x", "MT", [1])]
    df = spark.createDataFrame([(t, "51") for t in texts], "value string, monitor string")
    got = {(r.channel, r.reading_type): r.value for r in monitor.to_readings(monitor.parse_lines(df)).collect()}
    assert got == {(1, "MT"): 3, (1, "CT"): 0, (1, "Pn"): 0, (2, "MT"): 0, (2, "CT"): 0, (2, "Pn"): 2}
    kept = monitor.filter_lines(df, dt.date(2025, 6, 19), 1, 1).collect()
    assert [r.value for r in kept] == texts[:2]
    assert monitor.parse_load_date("06/20/25") == dt.date(2025, 6, 20)


def test_metadata(spark):
    rows = ["Monitor Channel Genotype Sex Treatment", "# note", "", "51_a ch01 Iso Female 2mM  Arg", "51_a ch2 na Female VEH", "short row"]
    got = monitor.parse_metadata(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.monitor, r.channel, r.genotype, r.treatment, r.fly_id) for r in got] == [("51_a", 1, "Iso", "2mM Arg", "M51_a_Ch01")]


def test_store(spark):
    old, new = (spark.createDataFrame(v, "k int, v string") for v in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "d")]))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(store.delete(old, new, ["k"])) == [(1, "a")]


def test_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    for e in (1, 2):
        store.write_partition(df, str(tmp_path / "t"), e)
    store.write_partition(df.where("v = 1"), str(tmp_path / "t"), 1)
    assert store.read_experiment(spark, str(tmp_path / "t"), 1).count() == 1 and store.read_experiment(spark, str(tmp_path / "t"), 2).count() == 2
    store.drop_experiment(spark, str(tmp_path), 1)
    assert store.read_table(spark, str(tmp_path / "t")).count() == 2


def test_hmm_finds_separate_states():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, (80, 2)) for m in (3, 0, -3, 3)])
    model = states.fit_hmm([x])
    path = states.viterbi(x, *model)
    assert len({*path[:80]}) == 1 and len({path[40], path[120], path[200]}) == 3 and path[300] == path[40]


def test_hdbscan_and_layout():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (30, 3)), rng.normal(5, 0.2, (30, 3)), [[20, -20, 20.0]]])
    labels, strength = ml.hdbscan_labels(x)
    assert len({*labels[:30]}) == 1 and len({*labels[30:60]}) == 1 and labels[0] != labels[30] and labels[60] == -1
    assert ((strength >= 0) & (strength <= 1)).all()
    y = ml.umap_layout(x[:60], epochs=60)
    a, b = y[:30].mean(0), y[30:].mean(0)
    assert np.linalg.norm(a - b) > max(np.linalg.norm(y[:30] - a, axis=1).mean(), np.linalg.norm(y[30:] - b, axis=1).mean())


def test_streaming_bouts(spark, tmp_path):
    from tidemark import streaming

    rows = [("f", dt.datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 4, 9, 15, 16)] + [("f", dt.datetime(2024, 1, 2), 1.0)]
    schema = "fly_id string, datetime timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = streaming.gap_bouts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bouts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("bouts").collect()) == [2, 3]
