import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from test_tokens import TEXTS, every_code_point

from tidemark.llm import alignment, queries

tokenizers = pytest.importorskip("tokenizers")
spm = pytest.importorskip("sentencepiece")
BYTE, PIECE = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(PIECE), reason="no tokenizer files")
MORE = ["a▁b", "▁", "x  ", "x   y", "  x", "<s>x</s> <unk>", "<0x41>", "\t", "end ", "a\0b", "漢字かな 🙂 \x01"]


def libraries():
    a = tokenizers.Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, spm.SentencePieceProcessor(model_file=PIECE)


def spelled(a, b):
    """Functions from an id to its bytes, for both libraries."""
    shift, extra = {}, 256
    for x in range(256):
        keep = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        shift[chr(x if keep else extra)] = x
        extra += not keep
    of_b = lambda i: bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    return lambda i: bytes(shift[c] for c in a.id_to_token(i)) if i < 50256 else a.id_to_token(i).encode(), of_b


def slow(texts):
    """(n_a, n_b, links, groups) of each text, by the two libraries and sets of ends."""
    a, b = libraries()
    bytes_a, bytes_b = spelled(a, b)
    for t in texts:
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        full = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, x)) != full or b"".join(map(bytes_b, y)) != full:
            yield 0, 0, [], ""
            continue
        ends = [dict(zip(np.cumsum([len(f(i)) for i in ids]).tolist(), ids, strict=True)) for f, ids in ((bytes_a, x), (bytes_b, y))]
        both = ends[0].keys() & ends[1].keys()
        cut = [[], []]
        for side, out in zip(ends, cut, strict=True):
            group = []
            for e, i in side.items():
                group.append(str(i))
                if e in both:
                    out.append(",".join(group))
                    group = []
        yield len(x), len(y), [(ends[0][e], ends[1][e]) for e in sorted(both)], ";".join(map("|".join, zip(*cut, strict=True)))


def expected(texts):
    found = list(slow(texts))
    count = Counter(p for *_, links, _ in found for p in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (n_a, n_b, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, links, g in found
    ], count


def test_tokens_and_groups_of_every_code_point():
    with open(BYTE, encoding="utf-8") as a, open(PIECE, "rb") as b:
        pair = alignment.open_pair(a.read(), b.read())
    texts = [*TEXTS, *MORE, *every_code_point()]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        n_a, n_b, n_links, a, b, groups = pair.align(some)
        want = list(slow(some))
        assert [(x, y, g.decode()) for x, y, g in zip(n_a.tolist(), n_b.tolist(), groups, strict=True)] == [(x, y, g) for x, y, _, g in want]
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == sum((links for *_, links, _ in want), []) and n_links.sum() == len(a)


@pytest.mark.parametrize("links", [1 << 20, 40])
def test_odd_documents(spark, odd, none, monkeypatch, links):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", links)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", links * 50)
    monkeypatch.setattr(alignment, "TABLE_WORDS", links * 10)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate([*TEXTS, *MORE])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pair int, count int")
    got, pairs = alignment.align_documents(docs, BYTE, PIECE)
    want, count = expected([t for _, t in rows])
    assert Counter(map(tuple, got.collect())) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == count
    assert alignment.align_documents(none, BYTE, PIECE)[0].count() == 0


def test_groups_as_text(spark):
    got = alignment.align_documents(spark.createDataFrame([(1, "unbelievable  things"), (2, None)], "doc_id long, text string"), BYTE, PIECE, groups="text")[0]
    want = {i: g for i, (*_, g) in enumerate(slow(["unbelievable  things", None]), 1)}
    assert {r.doc_id: r.groups_text for r in got.collect()} == want and want[1]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want, _ = expected([r.text for r in rows])
    assert Counter(map(tuple, queries.op13_alignment(spark, folder).collect())) == Counter((r.doc_id, *w) for r, w in zip(rows, want, strict=True))


def test_a_task_of_many_chunks_holds_few_of_them_at_once(spark, monkeypatch):
    """Chunks of a megabyte in one task are written in row groups of a few, however many they are: writer and reader hold a group."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(alignment, "CHUNK_LINKS", 1 << 17)
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat(concat('some words of text ', id, ' '), 24000) AS text")
    kept, keep = [], alignment.Scratch.keep
    monkeypatch.setattr(alignment.Scratch, "keep", lambda self, df, *a, **k: kept.append(keep(self, df, *a, **k)) or kept[-1])
    alignment.align_documents(docs, BYTE, PIECE)
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{kept[0]._tidemark_path}/*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in metas for i in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) <= 10 << 20, sizes
