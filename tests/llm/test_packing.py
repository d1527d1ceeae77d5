import os
import zlib

import numpy as np
import pytest

from tidemark.llm import packing, queries

tokenizers = pytest.importorskip("tokenizers")
BYTE = queries.tokenizer_file("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE), reason="no tokenizer files")


def fewest(items, capacity):
    """The least number of sequences, by trying every placement."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        tried = set()
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in tried:
                tried.add(rooms[k])
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def packed(counts):
    """The number of sequences of the plan, after every piece has been put where the plan says."""
    runs, made = packing.plan(counts)
    found, sequences = np.zeros(len(counts), int), {}
    for w, rank, n, sequence, per, offset in runs.tolist():
        assert rank == found[w]
        found[w] += n
        for i in range(n):
            sequences.setdefault(sequence + i // per, []).append((offset + i % per * w, w))
    assert (found == counts).all() and sorted(sequences) == list(range(made))
    for pieces in sequences.values():
        at = 0
        for offset, w in sorted(pieces):
            assert offset == at
            at += w
        assert at < len(counts)
    return made


def test_reduction_loses_no_sequence():
    rng, worse = np.random.default_rng(0), 0
    for t in range(600):
        capacity = int(rng.integers(4, 30))
        low, high = (1, capacity) if t % 2 else (max(1, capacity // 5), max(1, capacity * 2 // 3))
        items = rng.integers(low, high + 1, int(rng.integers(0, 10)))
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, left = packing.reduce(counts)
        best = fewest(items.tolist(), capacity)
        assert sum(n for _, n in fixed) + fewest(np.repeat(np.arange(capacity + 1), left).tolist(), capacity) == best
        assert packing.least_sequences(counts) <= best <= packed(counts)
        worse += packed(counts) > best
    assert worse <= 6


def test_many_pieces_come_near_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1025, 300_000), np.clip(rng.lognormal(5, 1.2, 300_000).astype(int), 1, 1024), np.full(100_000, 7)):
        counts = np.bincount(lengths, minlength=1025)
        runs, made = packing.plan(counts)
        assert made <= 1.002 * packing.least_sequences(counts) and len(runs) < 20_000


def check(rows, docs, capacity):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    want = sorted((d is not None, d or 0, p, s, n, c) for d, t in docs for p, s, n, c in cut(lib.encode(t or "", add_special_tokens=False).ids + [2], capacity))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= capacity
    counts = np.bincount([r.length for r in rows], minlength=capacity + 1)
    assert len(sequences) <= packing.least_sequences(counts) + 1


def cut(ids, capacity):
    starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
    for k, a in enumerate(starts):
        piece = ids[a : starts[k + 1] if k + 1 < len(starts) else len(ids)]
        yield k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [1024, 16])
def test_odd_documents(spark, odd, none, capacity):
    check(packing.pack_documents(odd, BYTE, capacity).collect(), [(r.doc_id, r.text) for r in odd.collect()], capacity)
    assert packing.pack_documents(none, BYTE).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.pack_documents(none, BYTE).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(queries.op12_packing(spark, folder).collect(), docs, 1024)
