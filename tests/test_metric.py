"""Metric joins, density clusters, global order and components, against all pairs and loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, graph, metric, order


def frame(spark, x, keys=None):
    return spark.createDataFrame([(int(k), [float(e) for e in v]) for k, v in zip(range(len(x)) if keys is None else keys, x, strict=True)], "k long, v array<double>")


def blobs(seed=0, n=600, d=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d)) * 10
    return np.concatenate([centres[rng.integers(0, 8, n - 40)] + rng.normal(size=(n - 40, d)), np.repeat(centres[:2], 20, axis=0)])


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("d", [1, 2, 16])
def test_nearest_and_within(spark, monkeypatch, d, small):
    if small:
        for name, value in (("SLICE", 20), ("GROUP", 7), ("DIRECTORY", 9), ("SHARED", 3)):
            monkeypatch.setattr(metric, name, value)
    x = blobs(d, 300, d).round(1)
    dist = metric.distances(x, x)
    got = {}
    for r in metric.nearest(frame(spark, x), "k", "v", 5).collect():
        got.setdefault(r.key, {})[r.place] = (r.other, r.distance)
    for i in range(len(x)):
        near = np.lexsort((np.arange(len(x)), dist[i]))[:5]
        assert [got[i][p] for p in range(5)] == [(int(j), dist[i, j]) for j in near]
    pairs = {(r.a, r.b) for r in metric.within(frame(spark, x), "k", "v", 1.0).collect()}
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(dist <= 1.0), strict=True)}


def test_few_pairs_are_looked_at(spark):
    x = blobs(3, 4000)
    slices = metric.Slices(frame(spark, x), "k", "v")
    near = slices.pairs_met(metric.usable(frame(spark, x), "k", "v").withColumn("radius", F.lit(0.2)))
    nearest = slices.pairs_met(slices.nearest_in_slice(6))
    assert near < 0.1 * len(x) ** 2 and nearest < 0.25 * len(x) ** 2
    plan = metric.within(frame(spark, x), "k", "v", 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_odd_points(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (None, [0.0, 0.0]), (3, [0.0, None]), (4, [float("nan"), 0.0]), (5, [0.1, 0.0])]
    points = spark.createDataFrame(rows, "k long, v array<double>")
    assert sorted(map(tuple, metric.nearest(points, "k", "v", 3).select("key", "place", "other").collect())) == [(1, 0, 1), (1, 1, 5), (5, 0, 5), (5, 1, 1)]
    assert sorted((r.k, r.cluster) for r in cluster.dbscan(points.where("k is not null"), "k", "v", 1.0, 2).collect()) == [(1, 0), (2, -1), (3, -1), (4, -1), (5, 0)]
    assert metric.nearest(points.where("false"), "k", "v", 3).count() == 0 and cluster.dbscan(points.where("false"), "k", "v", 1.0, 2).count() == 0


def slow_clusters(x, eps, least):
    near = metric.distances(x, x) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(axis=1), len(x))
        if np.array_equal(new, label):
            break
        label = new
    number = {v: i for i, v in enumerate(sorted(set(label[core].tolist())))}
    own = [number.get(int(v), len(x)) for v in label]
    beside = [min([own[j] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(x))]
    return {i: (own[i] if core[i] else beside[i]) for i in range(len(x))}


@pytest.mark.parametrize("seed", range(3))
def test_density_clusters(spark, monkeypatch, seed):
    monkeypatch.setattr(metric, "SLICE", 50)
    monkeypatch.setattr(metric, "GROUP", 30)
    x = blobs(seed, 400).round(1)
    got = {r.k: r.cluster for r in cluster.dbscan(frame(spark, x), "k", "v", 0.5, 5).collect()}
    assert got == slow_clusters(x, 0.5, 5) and len(set(got.values())) > 3 and -1 in got.values()


def test_places_and_differences(spark):
    values = [5.0, 1.0, 9.0, 1.0, 7.0, 30.0, 2.0, 8.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d double").repartition(3)
    got = order.numbered(df, ["d", "i"])
    assert [(r.i, r.place) for r in got.orderBy("place").collect()] == [(i, p) for p, i in enumerate(sorted(range(8), key=lambda i: (values[i], i)))]
    ranked = sorted(values)
    for stretch in (1, 2, 3, 100):
        rows = order.with_next(got.select("d", "place"), "d", "place", 2, stretch).orderBy("place").collect()
        assert [(r.d, r.next1, r.next2) for r in rows] == [(*ranked[i : i + 3], None, None)[:3] for i in range(8)]
    down = order.numbered(df, [F.desc("d"), "i"])
    assert down.where("place = 0").first().d == 30.0
    assert order.numbered(df.where("false"), ["d"]).columns == ["i", "d", "place"]
    assert cluster.elbow(df.limit(2), "d").count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (3, 10), (20, 21), (21, 22), (22, 20)], "a long, b long")
    assert {r.node: r.label for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8, 7: 7, 20: 20, 21: 20, 22: 20}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(chain).select("label").distinct().count() == 1
