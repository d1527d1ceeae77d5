import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, cls int, q long, x string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def slow(rows):
    """The same by every pair of rows."""
    rows = {(i, tuple(math.floor(256 * x) for x in v), (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v, c in rows:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, k == c) for j, w, k in rows if j != i)
        for s, j, _ in [r for r in scored if r[2]][:5]:
            fit = [r for r in scored if not r[2] and -50 * s <= -100 * r[0] <= -95 * s][:3]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label, **more)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [2048, 40, 3])
def test_all_pairs_agree(spark, monkeypatch, block):
    """Clusters, copies and ties; small annuli take several rounds, and few broadcast bounds several slices."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "FIRST", 2)
    monkeypatch.setattr(negatives, "DIRECTORY", 30)
    monkeypatch.setattr(negatives, "GROUP", 3)
    monkeypatch.setattr(negatives, "SHARED", 2)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).round(1).tolist(), int(rng.integers(0, 10))) for i in range(500)]
    rows += [(500 + i, rows[100][1], i % 3) for i in range(150)] + [(800 + i, rows[50][1], rows[50][2]) for i in range(40)]
    got = run(spark, rows)
    assert got == slow(rows) and len(got) > 100


def test_several_pivots(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.2).tolist(), int(rng.integers(0, 10))) for i in range(2500)]
    assert run(spark, rows) == slow(rows)


def test_odd_rows(spark):
    odd = [
        (0, [1.0, 0.0], 1), (50, [0.5, 0.5], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.0], 2), (2, [0.7, 0.0], 2), (2, [0.6, 0.0], 1), (3, None, 1), (4, [1.0, 1.0], None),
        (5, [1.0, None], 1), (6, [1.0, float("nan")], 1), (8, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0], 2), (10, [], 3), (11, [0.0, 0.0], 1), (100, [0.0, 0.0], 1), (12, [0.8, -0.5, 3.0], 4), (150, [-1.0, -1.0], 5), (13, [0.3, 0.3], 5),
    ]
    assert run(spark, odd) == slow(odd)
    for few in ([], [(0, [1.0], 1)], [(1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(0, None, None)]):
        assert run(spark, few) == slow(few)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 5e4 + 2e5).tolist(), int(rng.integers(0, 10))) for i in range(300)]
    assert run(spark, rows) == slow(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_hardnegatives(spark, folder).collect())) == slow(rows)
