"""Frames for plots against loops, and against the geometry that contour lines must have."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import plots

SCHEMA = "g string, x double, y double"


def by_hand(x, y, n=50):
    x, y = np.asarray(x), np.asarray(y)
    cov = np.cov(x, y) * len(x) ** (-1 / 3)
    inv = np.linalg.inv(cov)
    out = np.zeros((n, n))
    for i, gx in enumerate(np.linspace(x.min(), x.max(), n)):
        for j, gy in enumerate(np.linspace(y.min(), y.max(), n)):
            d = np.stack([x - gx, y - gy])
            out[i, j] = np.exp(-0.5 * (d * (inv @ d)).sum(0)).sum()
    return out / (len(x) * 2 * np.pi * np.sqrt(np.linalg.det(cov)))


def clouds(seed=3):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(400, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]]), r.normal(size=(60, 2)) + 4
    return a, np.vstack([b, b[:20]])  # repeated rows count as often as they stand


def as_grid(rows, n=50):
    out = np.full((n, n), np.nan)
    for r in rows:
        out[r.i, r.j] = r.density
    return out


def test_density_is_the_kernel_sum_of_each_group(spark):
    a, b = clouds()
    rows = [("a", *map(float, p)) for p in a] + [(None, *map(float, p)) for p in b]
    rows += [("a", None, 1.0), ("a", float("nan"), 1.0), ("a", 1.0, float("inf")), ("two", 0.0, 0.0), ("two", 1.0, 1.0)]
    rows += [("line", float(k), 2.0 * k) for k in range(9)] + [("same", 1.0, 1.0)] * 5
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = plots.density(df, "x", "y", "g", n=20).collect()
    assert {r.g for r in got} == {"a", None}
    for g, p in (("a", a), (None, b)):
        np.testing.assert_allclose(as_grid([r for r in got if r.g == g], 20), by_hand(*p.T, 20), rtol=1e-9)
    alone = plots.density(df.where("g = 'a'"), "x", "y", n=20)
    assert alone.columns == ["i", "j", "gx", "gy", "density"]
    np.testing.assert_allclose(as_grid(alone.collect(), 20), by_hand(*a.T, 20), rtol=1e-9)
    assert plots.density(df.where("false"), "x", "y", "g").count() == 0


def test_counting_on_a_lattice_stays_near_the_sum(spark):
    a, _ = clouds()
    df = spark.createDataFrame([("a", *map(float, p)) for p in a], SCHEMA)
    got, want = as_grid(plots.density(df, "x", "y", "g", n=20, per_bandwidth=16).collect(), 20), by_hand(*a.T, 20)
    assert np.abs(got - want).max() < 0.01 * want.max()


def nodes(spark, values):
    return spark.createDataFrame([("a", i, j, float(i), float(j), float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "g string, i int, j int, gx double, gy double, density double")


def test_levels_are_multiples_of_a_round_step(spark):
    got = sorted(r.level for r in plots.levels(nodes(spark, [[0.03, 0.5], [0.2, 0.83]]), "g").collect())
    assert got == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
    assert plots.levels(nodes(spark, [[1, 1], [1, 1]]), "g").count() == 0


def test_contours_close_and_lie_on_their_level(spark):
    at = np.linspace(-2, 2, 31)
    values = np.exp(-(at[:, None] ** 2) - at[None, :] ** 2)  # every line is a circle within the grid, or leaves by its border
    got = plots.contours(nodes(spark, values), "g").collect()
    assert got and len({(r.level, r.i, r.j, r.piece) for r in got}) == len(got)
    for level in {r.level for r in got}:
        ends = Counter((round(x, 9), round(y, 9)) for r in got if r.level == level for x, y in ((r.x1, r.y1), (r.x2, r.y2)))
        border = {p for p in ends if p[0] in (0, 30) or p[1] in (0, 30)}
        assert all(n == (1 if p in border else 2) for p, n in ends.items())
        if level > values[0].max():
            assert not border
            radius = np.sqrt(-np.log(level)) / (at[1] - at[0])
            assert all(abs(np.hypot(x - 15, y - 15) - radius) < 0.2 for x, y in ends)


def test_a_saddle_keeps_the_diagonal_its_mean_sides_with(spark):
    for values, joined in (([[1, 0], [0, 0.9]], False), ([[1, 0.4], [0.4, 1]], True)):
        got = plots.contours(nodes(spark, values), "g").where(F.abs(F.col("level") - (0.56 if joined else 0.6)) < 1e-9).collect()
        assert len(got) == 2
        # joined high corners: each piece cuts off a low corner, (1, 0) or (0, 1); else it cuts off a high one
        cut_off = {min(((cx - (r.x1 + r.x2) / 2) ** 2 + (cy - (r.y1 + r.y2) / 2) ** 2, (cx, cy)) for cx in (0, 1) for cy in (0, 1))[1] for r in got}
        assert cut_off == ({(1, 0), (0, 1)} if joined else {(0, 0), (1, 1)})


def test_scree_distances_and_shares(spark):
    assert [tuple(r) for r in plots.scree(spark, np.array([0.5, 0.25])).collect()] == [(1, 0.5, 0.5), (2, 0.25, 0.75)]
    far = spark.createDataFrame([(7, 1, 0.5), (3, 1, 0.5), (5, 1, 0.1), (5, 0, 0.0)], "key long, k int, distance double")
    assert [tuple(r) for r in plots.k_distances(far, 1).orderBy("place").collect()] == [(0, 5, 0.1), (1, 3, 0.5), (2, 7, 0.5)]
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "x")], "w string, p string")
    assert {tuple(r) for r in plots.shares(df, "w", "p").collect()} == {("a", "x", 2, 2 / 3), ("a", None, 1, 1 / 3), (None, "x", 1, 1.0)}
