import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import nearcopies


def grams(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def groups(texts):
    """Components of all pairs of similarity 0.8 or more, by comparing all; texts without words are one group."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (5 * len(a & b) >= 4 * len(a | b)) if a or b else True:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def corpus():
    """Texts of 40 to 400 words: copies with one to twelve words changed, one group of 80 copies, and chains of copies of copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    change = lambda t, k: (lambda w: [w.__setitem__(rng.randrange(len(w)), word()) for _ in range(k)] and " ".join(w))(t.split())
    texts = [" ".join(word() for _ in range(rng.randint(40, 400))) for _ in range(60)]
    for b in range(60):
        texts += [change(texts[b], rng.randint(1, 12)) for _ in range(3)]
    hot = " ".join(word() for _ in range(200))
    texts += [hot] + [change(hot, rng.randint(1, 6)) for _ in range(80)]
    for _ in range(8):
        texts.append(change(texts[-1], 3))
    return texts + ["one two", "ONE two", "", "  ", None]


def test_pipeline_stage_against_all_pairs(spark):
    texts = corpus()
    want = sorted({g for g in groups(texts)})
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(texts) - 60


def test_odd_rows(spark, odd, none):
    got = nearcopies.keep_one_of_each(odd)
    assert got.columns == odd.columns and nearcopies.keep_one_of_each(none).count() == 0
    assert sorted((r.doc_id or 0, r.text or "")[0] for r in got.collect()) == [0, 1, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_bands_find_similar_sets(least):
    rng, met = np.random.default_rng(1), 0
    for _ in range(400):
        n = int(rng.integers(20, 600))
        own = int(n * (1 - least) / (1 + least))  # of n hashes each
        a = rng.integers(0, 1 << 64, n + own, dtype=np.uint64)
        x, y = np.unique(a[:n]), np.unique(a[own:])
        assert nearcopies.similar(x, y)
        met += bool(set(nearcopies.band_keys(x).tolist()) & set(nearcopies.band_keys(y).tolist()))
    assert met >= 399


def test_the_stage_takes_pairs_from_simhash(spark, monkeypatch):
    from tidemark.llm import simhash
    from tidemark.llm.common import Scratch

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    said = [" ".join(word() for _ in range(400)) for _ in range(20)]
    texts = said + [t + " " + word() for t in said]
    near = {i for i in range(20) if bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[20 + i])).count("1") <= 4}
    df, found, links = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], simhash.fingerprint_links
    prints = df.select("doc_id", nearcopies._signed(5)("text").alias("s")).select("doc_id", "s.*").cache()
    ids = {r.node: r.doc_id % 20 for r in prints.collect()}
    pairs = nearcopies._simhash_pairs(prints, Scratch(spark, "test")).collect()
    assert {ids[r.node] for r in pairs} == near and all(ids[r.node] == ids[r.other] for r in pairs) and len(near) > 10
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: found.append(a) or links(*a))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == list(range(20)) and found
