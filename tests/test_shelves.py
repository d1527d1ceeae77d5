"""What a metric join shuffles, links joined within a task, and block distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, graph, metric


def test_a_group_travels_once_to_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(metric, "SLICE", 20)
    monkeypatch.setattr(metric, "SHELVES", 4)
    x = np.random.default_rng(1).normal(size=(1600, 32))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    slices = metric.Slices(points, "k", "v")
    asked = slices.nearest_in_slice(3)
    sent = sum(g.agg(F.sum(F.length("keys") / 8)).first()[0] for g in slices.groups(asked))
    shelves = slices.table.select("shelf").distinct().count()
    assert slices.count >= 80 and shelves <= 12 and sent <= 1600 * shelves


def test_links_within_a_task(spark):
    r = np.random.default_rng(2)
    pairs = r.integers(0, 300, (250, 2)).tolist()
    links = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(3)
    few = graph.spanning(links, most=20).collect()
    nodes = {n for p in pairs for n in p}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    def classes(links):
        for n in nodes:
            root[n] = n
        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {n: find(n) for n in nodes}

    assert classes(pairs) == classes([(r.a, r.b) for r in few]) and len(few) <= 3 * len(nodes)


@pytest.mark.parametrize("far", [0, 1e6])
def test_block_distances(far):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 5)) + far
    y = np.concatenate([x[:40], x[:20] + 1e-7, r.normal(size=(200, 5)) + far])
    got, want = cluster._distances(x, y), metric.distances(x, y)
    assert (got[np.arange(40), np.arange(40)] == 0).all()
    np.testing.assert_allclose(got, want, rtol=1e-9)
    near = metric.near_distances(x, y, np.full(300, 1.5))
    assert np.array_equal(near[want <= 1.5], want[want <= 1.5]) and (near[want > 1.6] >= 1.6).all()
