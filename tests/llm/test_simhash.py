import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import Scratch
from tidemark.llm.components import component_labels


def slow_print(text, width=4):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    grams = [b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(prints, budget):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d e\x0bf\tg", "Ünï É été Ä " * 9, "x y " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_print(text)


@pytest.mark.parametrize("budget", [0, 2, 4])
@pytest.mark.parametrize("hot", [4096, 8])
def test_links_against_all_pairs(spark, monkeypatch, budget, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    p = base[rng.integers(0, 12, 300)]
    for _ in range(4):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    p = np.unique(p)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(int(v),) for v in p.view(np.int64)], "fp long")
    labels = {r.node: r.label for r in component_labels(simhash.fingerprint_links(df, scratch, budget), scratch).collect()}
    assert same_groups([labels.get(v, v) for v in p.view(np.int64).tolist()], components([int(v) for v in p], budget))


@pytest.mark.parametrize("n", [100, 10**6, 10**9, 10**12])
def test_some_key_is_shared(n):
    blocks, agree = simhash.plan_blocks(n, 4)
    masks, rng = simhash.block_masks(blocks, agree), np.random.default_rng(3)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.label for r in component_labels(links, Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[201] == 200 and 100 not in got
    assert component_labels(links.where("false"), Scratch(spark, "test")).count() == 0


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[3, "0" * 16] == by[None, "0" * 16] == 1
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r.text in (None, "") or not r.text.strip() for r in rows) == 1 and sum(r.doc_id == 5 for r in rows) == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one_of_each(none).count() == 0


def test_components_name_the_smallest_id(spark):
    docs = spark.createDataFrame([(9, "a b c d e f"), (4, "A B c d e f"), (7, "other words stand here now"), (None, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(9, 4), (4, 4), (7, 7), (None, 4)}
    assert docs.select(F.count(F.lit(1))).first()[0] == 4


def test_keys_stay_whole(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(simhash, "WALK_ROWS", 10)
    rows = pd.DataFrame({"mask": [1] * 30 + [2] * 5, "key": [0] * 3 + [1] * 25 + [2] * 7, "sub": 0, "fp": range(35), "side": 0})
    for size in (1, 4, 7, 35):
        parts = list(simhash._whole_keys(rows.iloc[a : a + size] for a in range(0, 35, size)))
        assert pd.concat(parts)["fp"].tolist() == list(range(35))
        names = [{*zip(p["mask"], p["key"], strict=True)} for p in parts]
        assert sum(map(len, names)) == len(set().union(*names))
    assert list(simhash._whole_keys(iter([rows.iloc[:0]]))) == []
