"""Alignment of two tokenizers: where tokens of a byte-level BPE (A) and of a piece model (B) end together.

A encodes a blank and the text, B the text, to which it adds the blank itself; strings of special tokens are plain text. The tokens of
either side have cumulative byte ends; merging both ascending sequences finds the ends they share, which cut the tokens into
groups, and link the A token and the B token that end there. Tasks emit packed chunks of documents: each chunk carries its documents'
counts, its distinct linked id pairs with how often each occurs, and its links as places among those pairs. Spark sums the pairs of all
chunks, takes each side's maximum, and joins both back to the pairs of each chunk, where a document's links look them up. So a
frequent pair is a row for each chunk that holds it, not for each of its links.

Null and empty texts have no tokens, nor have texts that a side doesn't give back byte by byte (such as those with U+2581, which B reads as
a blank). Texts of any length are aligned whole. Repeated rows and null ids are rows like others, and count as often as they occur.
Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.common import Scratch
from tidemark.llm.tokenfile import Encoder

#: Links after which a chunk is closed, characters of text that are aligned at once, and pieces of text that a worker keeps of each side.
CHUNK_LINKS, BLOCK_CHARS, TABLE_WORDS = 1 << 19, 300_000, 300_000
CHUNKS = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups array<string>, pairs array<long>, counts array<long>, links binary"
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {groups} string"


class ByteSide:
    """A: the tokens of a blank and a text, and the bytes of each id."""

    def __init__(self, spec: str):
        self.encoder = Encoder(spec, TABLE_WORDS)
        self.encoder.library.encode_special_tokens = True
        value = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        vocab = self.encoder.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes[i] = b"".join(value.get(c) or c.encode() for c in token)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoder.encode([" " + t for t in texts])


class PieceSide:
    """B: the tokens of a text, to which the model adds a blank, and the bytes of each id.

    Where no piece goes on with a blank, no merge reaches over the start of a run of blanks: each run and what follows it is
    encoded once and kept. Other models encode whole texts.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        pieces, rules = [p.piece for p in spec.pieces], spec.normalizer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        self.words = regex.compile(r" +[^ ]*").findall if plain and "▁" in pieces and not any("▁" in p.lstrip("▁") for p in pieces) else None
        named = regex.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := named.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.table: dict[str, bytes] = {}
        self.blank = np.array([pieces.index("▁")], "<u4").tobytes() if "▁" in pieces else b""

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.library.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return self._whole(texts)
        split = [self.words(" " + t) for t in texts]
        new = set().union(*split).difference(self.table)
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table, new = {}, set().union(*split)
        new = sorted(new)
        self.table.update(zip(new, self._whole([w[1:] for w in new]), strict=True))
        self.table[" "] = self.blank  # a blank alone, at the end: the model adds none to an empty text
        return [b"".join(map(self.table.__getitem__, words)) for words in split]


class Pair:
    """Both sides, and what the merge needs of their vocabularies."""

    def __init__(self, spec_a: str, model_b: bytes):
        self.sides = (ByteSide(spec_a), PieceSide(model_b))
        self.lens = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        digits = [str(i).encode() for i in range(max(map(len, self.lens)))]
        self.wide = max(map(len, digits)) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(self.wide) for d in digits), np.uint8).reshape(-1, self.wide)
        self.n_digits = np.array([len(d) for d in digits], np.int64)

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text on both sides; none where a side doesn't give back the blank and the text."""
        full = [t or "" for t in texts]
        found = [[np.frombuffer(raw, "<u4") for raw in s.encode(full)] for s in self.sides]
        want = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in full]
        none = np.zeros(0, "<u4")
        good = [t and all(b"".join(map(s.bytes.__getitem__, ids[i].tolist())) == w for s, ids in zip(self.sides, found, strict=True)) for i, (t, w) in enumerate(zip(full, want, strict=True))]
        return tuple([x if g else none for x, g in zip(ids, good, strict=True)] for ids in found)

    def align(self, texts: list[str | None], write: bool = True):
        """(A tokens, B tokens, links of each text; A ids, B ids of all links; groups of each text as ``a1,a2|b1;a3|b2,b3``)."""
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in tokens)
        a, b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in tokens)
        ends_a, ends_b = np.cumsum(self.lens[0][a]), np.cumsum(self.lens[1][b])
        at = np.searchsorted(ends_b, ends_a)
        hit_a = ends_b[at] == ends_a if len(b) else np.zeros(len(a), bool)
        place_a, place_b = np.flatnonzero(hit_a), at[hit_a]
        n_links = np.diff(np.r_[0, np.searchsorted(place_a, np.cumsum(n_a))])
        groups = self._written(a, b, place_a, place_b, n_links) if write else [b""] * len(texts)
        return n_a, n_b, n_links, a[place_a], b[place_b], groups

    def _written(self, a, b, place_a, place_b, n_links) -> list[bytes]:
        """Each text's groups: the tokens of all groups in one table of digits, each with the sign that follows it."""
        size_a, size_b = np.diff(np.r_[-1, place_a]), np.diff(np.r_[-1, place_b])
        start_b, end_a = place_b + 1 - size_b, place_a + 1
        to_a = np.arange(len(a)) + np.repeat(start_b, size_a)
        to_b = np.arange(len(b)) + np.repeat(end_a, size_b)
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[to_a], ids[to_b] = a, b
        sign[to_a[place_a]], sign[to_b[place_b]] = ord("|"), ord(";")
        size = self.n_digits[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), size] = sign
        flat = rows[np.arange(self.wide) <= size[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(size + 1)]
        closed = np.r_[0, to_b[place_b] + 1][np.cumsum(n_links)]  # tokens up to the end of each text
        stops = ends[closed]
        return [flat[x : y - 1] if y > x else b"" for x, y in zip(np.r_[0, stops[:-1]].tolist(), stops.tolist(), strict=True)]


_OPEN: dict[int, Pair] = {}


def open_pair(spec_a: str, model_b: bytes) -> Pair:
    """A Python worker's pair of these files, which tasks that follow one another share."""
    if (key := hash((spec_a, model_b))) not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Pair(spec_a, model_b)
    return _OPEN[key]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """doc_ids and texts of a batch, in blocks of BLOCK_CHARS or one text."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    at = 0
    while at < len(ids):
        to, chars = at, 0
        while to < len(ids) and (to == at or chars + len(texts[to] or "") <= BLOCK_CHARS):
            chars += len(texts[to] or "")
            to += 1
        yield ids[at:to], texts[at:to]
        at = to


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, groups: str = "sha256") -> DataFrame:
    """Packed chunks, CHUNKS. ``groups`` is what is kept of a document's groups: their SHA-256, or the "text"."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    kept = (lambda g: hashlib.sha256(g).hexdigest() if g else "") if groups == "sha256" else bytes.decode

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, held, links, made = open_pair(*shared.value), TaskContext.get().partitionId(), [], 0, 0
        schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_links")), ("groups", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary())])

        def close() -> pa.RecordBatch:
            nonlocal held, links, made
            ids, n_a, n_b, n_links, keys, text = zip(*held, strict=True)
            pairs, place, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            row = [(part << 32) + made, sum(ids, []), *map(np.concatenate, (n_a, n_b, n_links)), sum(text, []), pairs, counts, place.astype("<u4").tobytes()]
            held, links, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for ids, texts in _blocks(batch):
                n_a, n_b, n_links, a, b, text = pair.align(texts)
                held.append((ids, n_a, n_b, n_links, a << 32 | b, [kept(g) for g in text]))
                links += len(a)
                if links >= CHUNK_LINKS:
                    yield close()
        if held:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(align, CHUNKS)


def pair_table(chunks: DataFrame) -> DataFrame:
    """The vocabularies' alignment: (pair, a, b, count, best_a, best_b), one row for each linked id pair. best_a is the highest count
    of its A id, best_b of its B id."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    a, b = F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")
    each = each.select("pair", a.alias("a"), b.alias("b"), "count")
    best_a, best_b = (each.groupBy(c).agg(F.max("count").alias(f"best_{c}")) for c in "ab")
    return each.join(best_a, "a").join(best_b, "b").select("pair", "a", "b", "count", "best_a", "best_b")


def align_documents(docs: DataFrame, path_a: str, path_b: str, groups: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): one row for each document, DOCUMENTS, whose last column is groups_sha256 or, on request, groups_text;
    and ``pair_table``."""
    scratch = Scratch(docs.sparkSession, "alignment")
    chunks = scratch.keep(aligned_chunks(docs, path_a, path_b, groups), wide=True)
    pairs = scratch.keep(pair_table(chunks))
    each = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    each = each.join(pairs, "pair").select(F.col("chunk").alias("of"), "place", "count", (F.col("count") == F.col("best_b")).alias("best"))
    schema = DOCUMENTS.format(groups=f"groups_{groups}")

    def look_up(chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: chunk.column(c)[0] for c in chunk.column_names}
        n_links, (n_a, n_b) = row["n_links"].values.to_numpy(), (row[c].values for c in ("n_a", "n_b"))
        place, table = found.column("place").to_numpy(), np.zeros((2, len(found)), np.int64)
        table[0, place], table[1, place] = found.column("count").to_numpy(), found.column("best").to_numpy()
        links = np.frombuffer(row["links"].as_py(), "<u4")
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(table[:, links], axis=1)], axis=1)
        ends = np.cumsum(n_links)
        count_sum, n_best = sums[:, ends] - sums[:, ends - n_links]
        columns = [row["doc_ids"].values, n_a, n_b, pa.array(n_links), pa.array(n_links), pa.array(n_best), pa.array(count_sum), row["groups"].values]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return chunks.groupBy("chunk").cogroup(each.groupBy("of")).applyInArrow(look_up, schema), pairs
