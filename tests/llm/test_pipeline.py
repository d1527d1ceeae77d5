"""The pipeline: each stage by itself against a slow version, all of them in order, and odd rows."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import bpe, queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which toxic texts, copies, near copies, repeated lines and benchmark passages are known."""
    root, rng = tmp_path_factory.mktemp("tables"), random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    clean, docs, labels = {i: text(rng.randint(6, 20)) for i in range(60)}, [], []
    docs += clean.items()
    docs += [(100 + i, clean[i]) for i in range(5)]  # copies
    docs += [(200 + i, text(3) + "\nwretched vermin wretched vermin wretched\n" + text(3)) for i in range(40)]
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(5)) + ".") for i in range(8)]
    docs += [(300 + i, text(4) + "\n" + t + "\n" + text(4)) for i, t in items]
    boiler = " ".join(word() for _ in range(15))
    docs += [(400 + i, text(5) + "\n" + boiler + ("." if i else "")) for i in range(6)]
    long = text(40).split("\n")
    docs += [(500, "\n".join(long))] + [(500 + k, " ".join(w if i % 100 != k else word() for i, w in enumerate(" ".join(long).split()))) for k in (1, 2)]
    labels = [(i, 1, int(200 <= i < 300)) for i, _ in docs]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_run(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {*range(60), *range(400, 406), 500}
    encoder = bpe.WordBpe.load(queries.tokenizer_file("word_bpe_49k.json"))
    kept = {i: docs[i].text if i <= 400 or i == 500 else docs[i].text.rsplit("\n", 1)[0] for i in got}
    for i, (raw, _) in zip(kept, encoder.encode(list(kept.values())), strict=True):
        assert got[i].n_tokens == len(raw) // 4


@pytest.mark.parametrize("k", range(5))
def test_stages_meet_odd_rows(spark, folder, odd, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, odd, folder)
    assert k == 4 or got.columns == odd.columns
    assert 0 < got.count() <= odd.count()
    assert stage(spark, none, folder).count() == 0
