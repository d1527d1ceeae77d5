import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(vectors, queries, k=5):
    out = {}
    for q in queries:
        scores = [(-float(np.dot(vectors[q], v) / (np.linalg.norm(vectors[q]) * np.linalg.norm(v))), i) for i, v in vectors.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=16) + 2 * (i % 5) for i in range(600)}
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    want, found = brute(vectors, range(0, 600, 20)), {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys() and all(len(v) == 5 for v in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    assert all(s == pytest.approx(dict(brute(vectors, [q], 600)[q])[i], abs=1e-12) for q, v in found.items() for i, s in v)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [0.0, 2.0], 1), (1, [3.0, 0.0], None), (2, [3.0, 0.0], 1), (2, [3.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [1.0, float("nan")], 1), (7, [float("inf"), 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (100, None, 1), (9, [1e-200, 1e-200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.707107), (0, 4, 50, 0.0), (50, 1, 9, 0.707107), (50, 2, 0, 0.0), (50, 3, 1, 0.0), (50, 4, 2, 0.0)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_copies_take_one_place(spark):
    """A group of copies far larger than the shortlist hides no neighbour, and ties in it go to the smallest ids."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    vectors = {1000 + i: base for i in range(400)} | {i: base + rng.normal(size=8) * 0.3 for i in range(60)}
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, shortlist=60).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[1000] == [1001, 1002, 1003, 1004, 1005] and got[1020] == [1000, 1001, 1002, 1003, 1004]
    for q in (0, 20, 40):
        close = [i for i, v in vectors.items() if i < 1000 and i != q and np.dot(v, vectors[q]) / np.linalg.norm(v) > np.dot(base, vectors[q]) / np.linalg.norm(base)]
        want = [i for i, _ in brute({i: vectors[i] for i in [*close, q]}, [q])[q]]
        assert got[q] == (want + [1000, 1001, 1002, 1003, 1004])[:5]


def test_codes_come_close():
    rng = np.random.default_rng(1)
    x = ann._unit(rng.normal(size=(800, 12)))
    books = ann.fit_books(x, m=4, k=32)
    errors = [((x - ann.decode(ann.beam_codes(x, books, beam=b), books)) ** 2).sum(1).mean() for b in (1, 8)]
    assert errors[1] < errors[0] < 0.5


def test_narrow_clusters_and_wide_offsets(spark):
    """Groups of near copies larger than the shortlist, alone among other rows or around an offset: codes alone can't rank their rows."""
    rng = np.random.default_rng(5)
    hot = rng.normal(size=24)
    narrow = np.concatenate([rng.normal(size=(2500, 24)), hot + rng.normal(size=(2500, 24)) * 1e-3])
    for x in (rng.permutation(narrow), rng.normal(size=(3000, 24)) * 0.01 + 5):
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        found = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, shortlist=64).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        cos = unit[::50] @ unit.T
        cos[np.arange(len(cos)), np.arange(0, len(x), 50)] = -2
        want = {50 * i: set(np.argsort(-row)[:5].tolist()) for i, row in enumerate(cos)}
        assert np.mean([len(found[q] & want[q]) / 5 for q in want]) > 0.999


def test_bound_holds():
    rng = np.random.default_rng(2)
    x, close, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(3, 4000, 5)))
    assert (ann.best_possible((q * close).sum(1), (x * close).sum(1)) >= (q * x).sum(1)).all()
