import hashlib
import os
import zlib

import numpy as np
import pytest

from tidemark.llm import bpe, queries, tokenfile

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = queries.tokenizer_file("word_bpe_49k.json"), queries.tokenizer_file("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(WORD), reason="no tokenizer files")
TEXTS = [
    "", " ", "Hello WORLD it's <|endoftext|>x <|startoftext|>", "Σας ΑΣ İstanbul été Å", "a" * 3000, "\x1c\x1d a\x85b c", "aaaa aaa aa 12345 don't'S !!! ###\n\t\v\f x",
    "<|endoftext|", "ﬁ ß ẞ 漢字 日本語 🙂👍🏽 ² ½ _ __x", "a  b", " a", "a ", "a\n\nb", "a \nb", "a\n b", "it's 12.\nOh, x", "\0a b\n\0c", "a \0b", "x\r\ny", "1. 2, ., a.,",
]


def test_word_bpe_is_the_library():
    lib, mine = tokenizers.Tokenizer.from_file(WORD), bpe.WordBpe.load(WORD)
    ids = [e.ids for e in lib.encode_batch(TEXTS, add_special_tokens=False)]
    for text, want, (raw, decoded) in zip(TEXTS, ids, mine.encode(TEXTS), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want, text
        assert decoded == lib.decode(want, skip_special_tokens=False) == mine.decode(want)


def test_small_table_of_words(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 5)
    mine, big = bpe.WordBpe.load(WORD), bpe.WordBpe.load(WORD)
    monkeypatch.undo()
    assert list(mine.encode(TEXTS)) == list(big.encode(TEXTS))


def test_encode_documents(spark, odd, none):
    lib = tokenizers.Tokenizer.from_file(WORD)
    got = bpe.encode_documents(odd, WORD, ids=True)
    assert got.count() == odd.count() and bpe.encode_documents(none, WORD).count() == 0
    for r in got.where("doc_id in (1, 4, 6, 8)").collect():
        text = {x.doc_id: x.text for x in odd.collect()}[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = got.select("decoded", bpe.decode_column(got, WORD).alias("again")).collect()
    assert all(r.decoded == r.again for r in back)


def every_code_point():
    """Texts that hold every code point (surrogates aside) between letters, after a digit, and between signs and blanks."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or c >= 0xE0000 and c < 0xE0200 or c % 257 == 0)]
    for at in range(0, len(points), 64):
        some = points[at : at + 64]
        yield " ".join(f"a{c}b 1{c} !{c}." for c in some)


def test_word_bpe_over_every_code_point():
    lib, mine, texts = tokenizers.Tokenizer.from_file(WORD), bpe.WordBpe.load(WORD), list(every_code_point())
    for text, want, (raw, _) in zip(texts, lib.encode_batch(texts, add_special_tokens=False), mine.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want.ids, ascii(text[:8])


def test_whole_texts_are_encoded():
    lib = tokenizers.Tokenizer.from_file(BYTE)
    with open(BYTE, encoding="utf-8") as f:
        mine = tokenfile.Encoder(f.read(), most=2000)
    texts = TEXTS + list(every_code_point())
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 50):
        for text, ids, raw in zip(texts[at : at + 50], want[at : at + 50], mine.encode(texts[at : at + 50]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == ids, ascii(text[:8])


def repeats(sym, ends):
    """The most places without overlap that a pair of neighbours within a document has."""
    seen = {}
    for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
        last = {}
        for k, pair in enumerate(zip(sym[a : b - 1].tolist(), sym[a + 1 : b].tolist(), strict=True)):
            if last.get(pair) == k - 1:
                del last[pair]
                continue
            last[pair] = k
            seen[pair] = seen.get(pair, 0) + 1
    return max(seen.values(), default=0)


@pytest.mark.parametrize("first", [8, 70_000, 1 << 30])
def test_no_pair_is_left_twice(first):
    rng = np.random.default_rng(first)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        ids = rng.integers(0, rng.integers(1, 8), n)
        ends = np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, 5))), n])
        sym, rules, got = tokenfile.compress(ids, ends, first)
        assert repeats(sym, got) < 2 and np.array_equal(tokenfile.expand(sym, rules, tokenfile.rule_lengths(rules, first), first), ids)
    text = np.tile(rng.integers(0, 8, 1000), 50)
    assert len(tokenfile.compress(text, np.array([len(text)]), first)[0]) < 20


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(1, rng.integers(2, 30), rng.integers(0, 400)), 0) for _ in range(rng.integers(1, 20))]
    if seed == 1:
        docs = [np.full(1000, 7), np.array([0])]
    counts, flat = np.array([len(d) for d in docs]), np.concatenate(docs)
    shard = tokenfile.Shard(tokenfile.pack([None, *range(1, len(docs))], flat, counts, 50257))
    assert shard.doc_ids[0] is None and all(np.array_equal(a[1], b) for a, b in zip(shard.documents(), docs, strict=True))
    for i, d in enumerate(docs):
        assert np.array_equal(shard.document(i), d)
    for _ in range(20):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2))
        assert b == a or np.array_equal(shard.slice(a, b), flat[a:b])
    assert len(shard.rules) == 0 or len(shard.symbols) < len(flat)
    assert tokenfile.rule_lengths(shard.rules, 50257).tolist() == shard.lengths.tolist()


def test_token_file(spark, odd, none, monkeypatch):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 500)
    got = sorted(tokenfile.token_file_report(odd, BYTE).collect(), key=lambda r: r.start)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        ids = [lib.encode(t, add_special_tokens=False).ids + [0] for t in texts[r.doc_id]]
        crcs = {(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids}
        assert r.start == at and (r.n_tokens, r.ids_crc32) in crcs
        at += r.n_tokens
    assert tokenfile.token_file_report(none, BYTE).count() == 0
