import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.common import held_out, labelled_sample, sampled_features


def corpus(spark, n=400):
    rng, rows, labels = np.random.default_rng(0), [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(5, 80))]
        bad, toxic = i % 5 == 0, i % 3 == 0
        if toxic:
            words.insert(len(words) // 2, "wretched")
        text = " ".join(w.upper() + "!!" for w in words) if bad else (" ".join(words) + ".").capitalize()
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "name"), [(quality.classify_quality, "quality"), (toxicity.classify_toxicity, "toxic")])
def test_held_out_accuracy(spark, run, name):
    docs, labels = corpus(spark)
    got = run(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 60 and np.mean([r.predicted == r[name] for r in got]) > 0.95


@pytest.mark.parametrize("run", [quality.classify_quality, toxicity.classify_toxicity])
def test_odd_rows_and_empty_tables(spark, odd, none, run):
    docs, labels = corpus(spark, 100)
    model_docs = docs.unionByName(odd.select("doc_id", "text").where("doc_id > 1000"))
    assert run(model_docs, labels.where("false")).where("score is null").count() == 0
    clash = labels.select("doc_id", "quality", "toxic", F.lit("x").alias("text"))
    got = run(odd, clash.unionByName(clash))
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert run(none, labels).count() == 0


def test_held_out_part(spark):
    got = spark.range(50).select(F.col("id"), held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_sample_leaves_out_held_out_null_and_contradicting(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(0, 0), (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    ids = {r.doc_id for r in labelled_sample(docs, labels, "quality", 1000).collect()}
    assert ids and 0 not in ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert labelled_sample(docs, labels, "quality", 5).count() == 5


def test_additive_model_is_its_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair can tell
    m = quality.fit_additive(x, y, rounds=20, pair_rounds=60)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9
    fine, rough = m.bins(x, m.cuts), m.bins(x, m.coarse)
    by_hand = [m.base + sum(t[b] for t, b in zip(m.tables, f, strict=True)) + sum(t[r[a], r[b]] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True)) for f, r in zip(fine[:20], rough[:20], strict=True)]
    assert np.allclose(m.margin(x[:20]), by_hand)


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("run", "name", "least"), [(quality.classify_quality, "quality", 0.98), (toxicity.classify_toxicity, "toxic", 0.75)])
def test_held_out_rows_of_the_tables(spark, run, name, least):
    """Share of pairs of held-out rows of both labels that the score puts in order."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = run(docs, labels).join(labels, "doc_id").where("held_out").select(name, "score").collect()
    good, bad = (np.array([r.score for r in rows if r[name] == k]) for k in (1, 0))
    assert len(good) > 5 and len(bad) > 5
    order = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert order >= least


def test_features_are_bounded(spark):
    docs, labels = corpus(spark, 60)
    sample = labelled_sample(docs, labels, "toxic", 50)
    sizes = {r.doc_id: r.n for r in sample.select("doc_id", F.size(toxicity.grams_udf(F.col("text"))).alias("n")).collect()}
    got = sampled_features(sample, toxicity.grams_udf(F.col("text")), 100 * max(sizes.values())).num_rows
    assert got == len(sizes)
    most = sum(sizes.values()) // 2
    kept = sampled_features(sample.where(F.size(toxicity.grams_udf(F.col("text"))) <= most // 100), toxicity.grams_udf(F.col("text")), most)
    assert sum(len(r) for r in kept.column("features").to_pylist()) <= most
