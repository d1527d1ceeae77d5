import datetime as dt

import pytest

from tidemark.sources import adapter


@pytest.mark.parametrize("users", [1, 4])
def test_dense_shuffles_events_only(spark, tmp_path, monkeypatch, users):
    """Bins are whole, odd events included; partitions grow in number with the events, and no bin is shuffled for a fly-day."""
    at = lambda d, h: dt.datetime(2024, 1, d, h, 30)
    rows = [(i, at(1 + i % 5, i % 24), i % 9, "error" if i % 7 == 0 else "view", None if i % 11 == 0 else 0.5 * i) for i in range(300)]
    rows += [(900, dt.datetime(2024, 3, 1, 5), 3, "view", 2.0), (901, None, 3, "view", 4.0), (902, at(2, 2), 40, "click", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(adapter, "PART_EVENTS", 10)
    got = adapter.dense(spark, str(tmp_path), users=users, missing=True)
    want = {(u // users, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)): (0, 0.0) for u in {r[2] for r in rows} for h in range(720)}
    bad = set()
    for _, t, u, kind, v in rows:
        k = u // users, t and t.replace(minute=0)
        n, s = want.get(k, (0, 0.0))
        want[k] = n + 1, s + (v or 0.0)
        bad |= {k} if kind == "error" else set()
    assert {(r.user_id, r.datetime): (r.n, r.value) for r in got.collect()} == {k: (None if k in bad else n, s) for k, (n, s) in want.items()}
    days = got.groupBy("fly_id", "exp_day").count()
    assert days._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and days.rdd.getNumPartitions() == 31
