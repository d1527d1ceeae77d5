"""Small operators on tables worked out by hand or by enumeration."""

import datetime as dt
import itertools
import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.functions import tails
from tidemark.operators import cluster, health, ml, states, stats
from tidemark.sources import files, store


@pytest.mark.parametrize(("n1", "n2"), [(1, 3), (3, 4), (5, 5), (2, 9)])
def test_rank_sums_against_all_arrangements(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    all_u = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)]
    for u in set(all_u):
        far = max(u, n1 * n2 - u)
        assert tails.rank_sum_exact(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(v >= far for v in all_u) / len(all_u)))


def test_mann_whitney_takes_the_exact_branch_without_ties(spark):
    rows = [("a", True, float(v)) for v in (1, 2, 3)] + [("a", False, float(v)) for v in (4, 5, 6)] + [("b", True, 1.0)] * 3 + [("b", False, v) for v in (1.0, 2.0, 3.0)]
    got = {r.feature: r for r in stats.mann_whitney(spark.createDataFrame(rows, "feature string, side boolean, value double"), ["feature"], F.col("side")).collect()}
    assert got["a"].u == 0 and got["a"].p_value == pytest.approx(0.1) and got["a"].rank_biserial == -1
    assert got["b"].p_value != pytest.approx(0.4)


def test_fisher_and_composition(spark):
    rows = [("f", "x")] * 8 + [("f", "y")] * 2 + [("m", "x")] * 1 + [("m", "y")] * 5
    two = spark.createDataFrame(rows, "sex string, cluster string")
    got = stats.composition(two, "sex", "cluster").collect()
    total = math.comb(16, 9)
    p = {k: math.comb(10, k) * math.comb(6, 9 - k) / total for k in range(3, 10)}
    assert [r.test for r in got] == ["Fisher exact"] and got[0].p_value == pytest.approx(sum(v for v in p.values() if v <= p[8] * (1 + 1e-7)))
    three = stats.composition(two.union(spark.createDataFrame([("m", "z")] * 3, "sex string, cluster string")), "sex", "cluster").collect()
    assert [r.test for r in three] == ["Chi-square (df=2)"]
    assert stats.composition(two.where("sex = 'f'"), "sex", "cluster").count() == 0


def test_agreement_by_chance_is_none(spark):
    same = [(i % 3, "abc"[i % 3]) for i in range(30)]
    got = cluster.agreement(spark.createDataFrame(same, "l int, r string"), "l", "r").first()
    assert got.ami == pytest.approx(1) and got.ari == pytest.approx(1)
    free = [(i % 2, "ab"[i // 2 % 2]) for i in range(40)]
    assert abs(cluster.agreement(spark.createDataFrame(free, "l int, r string"), "l", "r").first().ami) < 0.05
    # expected information of one pair of margins, by all arrangements of 2 of 4
    n = 4
    every = [len({0, 1} & set(c)) for c in itertools.combinations(range(n), 2)]
    want = sum(k / n * math.log(n * k / 4) for k in every if k) / len(every)
    assert tails.expected_cell(2, 2, 4) == pytest.approx(want)


def test_noise_is_no_cluster(spark):
    rows = [(1, 0, 0.0), (2, 0, 1.0), (3, 1, 10.0), (4, 1, 11.0), (5, -1, 500.0)]
    points = spark.createDataFrame(rows, "k long, label long, x double").withColumn("v", F.array("x"))
    assert cluster.silhouette(points, "k", "label", "v").first()[0] == pytest.approx(((10.5 - 1) / 10.5 + (9.5 - 1) / 9.5) / 2)
    assert cluster.centroid_scores(cluster.components_long(points, "k", "label", "v")).first().n_clusters == 2
    flies = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "fly_id string, x double")
    found = spark.createDataFrame([("a", 0), ("b", -1)], "fly_id string, cluster_hdbscan int")
    assert [(r.fly_id, r.cluster) for r in cluster.with_clusters(flies, found).collect()] == [("a", 0)]
    assert sorted((r.fly_id, r.cluster) for r in cluster.with_clusters(flies, found, "left", True).collect()) == [("a", 0), ("b", -1), ("c", None)]


def test_density_clusters_say_when_they_have_not_settled(spark):
    line = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "k long, v array<double>")
    assert {r.cluster for r in cluster.dbscan(line, "k", "v", 1.0, 2).collect()} == {0}
    with pytest.raises(RuntimeError):
        cluster.dbscan(line, "k", "v", 1.0, 2, most_rounds=1)


def test_stability_verdict(spark):
    grid = lambda *v: spark.createDataFrame([(x,) for x in v], "ari_label double")
    said = [ml.stability_verdict(grid(*v)).collect() for v in ((0.5, 0.51), (0.5, 0.65), (0.1, 0.9), (0.4, None))]
    assert [r[0].verdict for r in said[:3]] == ["robust", "moderate", "sensitive"] and not said[3]


def test_candidate_bouts_and_failed_models(spark):
    t = dt.datetime(2025, 1, 1)
    at = lambda k: t + dt.timedelta(minutes=5 * k)
    rows = [("a", "Iso", at(k), "HMM_candidate") for k in (0, 1, 2, 5, 6, 20)] + [("a", "Iso", at(3), "Sleep"), ("b", "Fmn", at(0), "HMM_candidate")]
    bins = spark.createDataFrame(rows, "fly_id string, genotype string, bin_start timestamp_ntz, state string").withColumn("sex", F.lit("f")).withColumn("treatment", F.lit("v"))
    kept = states.candidate_bouts(bins, 5, 2).collect()
    assert sorted((r.fly_id, r.bin_start, r.bout) for r in kept) == [("a", at(k), b) for k, b in ((0, 1), (1, 1), (2, 1), (5, 2), (6, 2))]
    decoded = spark.createDataFrame([("a", at(k), "Healthy") for k in (0, 1, 2)] + [("b", at(0), "HMM_FAILED")], "fly_id string, bin_start timestamp_ntz, state string")
    table = {r.fly_id: r for r in states.quality_table(states.with_decoded(bins, decoded)).collect()}
    assert table["a"].decision == "Keep" and table["a"].pct_sleep == 25 and table["b"].decision == "HMM_FAILED" and table["b"].n_bins is None


def test_flies_leave_every_table(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "experiment_id int, fly_id string")
    left = store.delete_flies({"flies": rows, "readings": rows, "features": rows, "experiments": rows}, rows.where("experiment_id = 1 and fly_id = 'a'"))
    assert list(left) == ["features", "readings", "flies"] and all(sorted(map(tuple, t.collect())) == [(1, "b"), (2, "a")] for t in left.values())
    new = spark.createDataFrame([(1, "x"), (1, "x"), (3, "y")], "experiment_id int, fly_id string")
    assert store.upsert(rows, new, ["experiment_id"]).count() == 3


def test_reports(spark, tmp_path):
    df = files.display_names(spark.createDataFrame([("waso_mean_z", 0.5), ("waso_mean", None), ("PC1", 2.0)], "feature string, value double"))
    assert [r.feature for r in df.collect()] == ["WASO", "WASO", "PC1"]
    files.write_text(spark, files.report({"Values": df, "Note": "none\n"}), str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == "Values\n------\nfeature  value\nWASO     0.5000000000\nWASO\nPC1      2.0000000000\n\nNote\n----\nnone\n"
    assert files.optional(spark, str(tmp_path / "absent")) is None


def stream(spark, tmp_path, rows, schema, make, mode="append"):
    """All rows that a streaming query gives over two batches and a late one that moves the watermark."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).format("parquet")
        query = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


T0 = dt.datetime(2025, 1, 1, 9)
LATER = [("z", T0 + dt.timedelta(days=9), "MT", 0)]
READINGS = "fly_id string, datetime timestamp, reading_type string, value int"


@pytest.mark.parametrize("which", ["hourly", "bins", "day", "bouts"])
def test_streams(spark, tmp_path, which):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(m), kind, m) for m in (0, 1, 2, 61, 70) for kind in ("MT", "Pn")]
    run = lambda make: [r for r in stream(spark, tmp_path, [rows, LATER, [("z", T0 + dt.timedelta(days=20), "MT", 0)]], READINGS, make) if r.fly_id == "a"]
    if which == "hourly":
        assert sorted((r.hour, r.total) for r in run(streaming.hourly_totals)) == [(at(0), 6), (at(60), 262)]
    elif which == "bins":
        assert sorted((r.bin_start, r.mt_sum, r.pn_var) for r in run(streaming.bins)) == [(at(0), 3, 1.0), (at(60), 61, 0.0), (at(70), 70, 0.0)]
    elif which == "day":
        assert [(r.day_end, r.total) for r in run(streaming.trailing_day)] == [(at(24 * 60), 268)]
    else:
        assert sorted((r.start, r.n) for r in run(lambda s: streaming.gap_bouts(s.where("reading_type = 'MT'"), "5 minutes"))) == [(at(0), 3), (at(61), 1), (at(70), 1)]


def test_death_corrects_days_that_went_out(spark, tmp_path):
    """The last row of each day equals the batch result, also when an earlier death arrives late."""
    days = [[("a", 1, "Alive"), ("a", 4, "Dead"), ("b", 1, "Alive"), ("a", 3, "Unhealthy")], [("a", 5, "Alive"), ("b", 2, "Unhealthy")], [("a", 2, "Dead"), ("a", 6, "QC_Fail"), ("b", 1, "Alive")], [("b", 2, "Dead"), ("c", 9, "Dead"), ("c", 1, "Alive")]]
    schema, sent = "fly_id string, exp_day int, status string", []
    for part in days:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = streaming.irreversible(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update")
        query = query.foreachBatch(lambda df, _: sent.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    assert sent[0] == [("a", 1, "Alive"), ("a", 3, "Unhealthy"), ("a", 4, "Dead"), ("b", 1, "Alive")]
    assert sent[2] == [("a", 2, "Dead"), ("a", 3, "Dead"), ("a", 6, "Dead")]  # the third day again; b's day was known
    last = {(f, d): s for batch in sent for f, d, s in batch}
    every = {(f, d): s for part in days for f, d, s in part}
    batch = health.irreversible(spark.createDataFrame([(*k, s) for k, s in every.items()], schema)).collect()
    assert last == {(r.fly_id, r.exp_day): r.status for r in batch}


def test_ids_are_claimed_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = sorted(pool.map(lambda _: store.claim_id(spark, str(tmp_path)), range(20)))
    assert got == list(range(1, 21))


def test_a_commit_takes_effect_as_one(spark, tmp_path):
    root = str(tmp_path / "store")
    read = lambda: [sorted(r.v for r in store.read_experiment(spark, f"{root}/{t}", 1).collect()) for t in ("readings", "flies")]
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    first = store.Commit(spark, root, 1)
    first.write("readings", table(1, 2, 3))
    first.write("flies", table(1))
    with pytest.raises(FileNotFoundError):
        read()
    first.finish()
    assert read() == [[1, 2, 3], [1]]
    broken = store.Commit(spark, root, 1)
    broken.write("readings", table(9))  # and then it fails: nothing has changed
    assert read() == [[1, 2, 3], [1]]
    next_ = store.Commit(spark, root, 1)
    next_.write("readings", store.read_experiment(spark, f"{root}/readings", 1).where("v < 3"))
    next_.write("flies", table(7))
    next_.finish()
    assert read() == [[1, 2], [7]]
    store.write_partition(table(5), f"{root}/flies", 2)
    assert sorted(map(tuple, store.read_table(spark, f"{root}/flies").select("experiment_id", "v").collect())) == [(1, 7), (2, 5)]
    store.drop_experiment(spark, root, 1)
    assert store.manifest(spark, root, 1) == {} and store.read_table(spark, f"{root}/readings") is None and store.read_table(spark, f"{root}/flies").count() == 1


def test_bucketed_tables_join_without_exchange(spark):
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select((F.col("id") % 50).cast("string").alias("fly_id"), "id")
        flies = spark.range(40).select(F.col("id").cast("string").alias("fly_id"), F.lit("x").alias("genotype"))
        both = store.with_flies(store.bucketed(rows, "rows"), store.bucketed(flies, "flies"))
        assert both.count() == 800 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    store.drop_bucketed(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]
