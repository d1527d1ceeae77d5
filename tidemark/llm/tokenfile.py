"""Token-id files: byte-level BPE ids in ascending doc_id order, compressed shard by shard with a Re-Pair grammar.

Each document is encoded whole by the tokenizers library and ended by an end id. A shard holds the ids of consecutive
documents as a straight-line grammar: the most frequent neighbouring ids are replaced by nonterminals until no pair repeats,
whatever the numbers of ids and rules. Pairs never reach over a document's end, so every document is a range of the shard's symbols, and the stored expansion lengths of the
rules let a reader find and expand any range of ids without the rest of the shard.

A file is a Parquet table of shards (part, shard, first, n_ids, payload); payload is the binary layout of ``pack``. Any
filesystem that Spark writes will do, and a lost executor costs only its unfinished shards.

Null texts count as empty (the end id alone). Null ids come first in the order, rows with equal ids follow by hash of
text and then text. Extra columns are ignored. No rows: an empty file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, has_unassigned

MAGIC = b"TMRP0002"
#: Ids after which a shard is closed, and how much rarer than the most frequent pair one may be that is replaced with it.
SHARD_IDS, STEP = 1 << 19, 8
#: Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Pieces of text whose ids a Python worker keeps, and their characters.
TABLE_WORDS, TABLE_CHARS = 1_000_000, 24_000_000
#: Fixed value: the characters that Unicode calls white space.
_BLANK = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OPEN: dict[int, Encoder] = {}


class Encoder:
    """The tokenizers library over whole texts, with a table of the pieces of text that it has encoded.

    A byte-level tokenizer cuts a text into words by a fixed pattern and encodes each by itself, so a word met before needs no
    second call. No word goes on with a blank after another sign: a run of blanks with the signs up to the next blank is cut
    alike wherever it stands, and is kept as well. Words that start with a blank are sent to the library as one text, which it cuts
    into these very words; the bytes of the tokens tell where one ends. Texts that hold an added token, or a code point that not all
    Unicode tables know, go to the library whole.
    """

    def __init__(self, spec: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # keep to the task's core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        settings = json.loads(spec)
        cut = settings["pre_tokenizer"] or {}
        fixed = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and not settings["normalizer"]
        self.words = regex.compile(WORDS).findall if fixed else None
        self.runs = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+").findall
        # a letter of a token stands for a byte
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.lens = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.lens[list(vocab.values())] = [len(t) for t in vocab]
        self.table: dict[str, bytes] = {}
        self.most, self.chars = most or TABLE_WORDS, 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: set[str]) -> None:
        """Put runs and their words into the table; none has an unassigned code point."""
        # a blank and letters, or letters alone, are one word
        mixed = {r: self.words(r) for r in runs if not (r.isalpha() or r[0] == " " and r[1:].isalpha())}
        words = runs.difference(mixed).union(*mixed.values()).difference(self.table)
        after = [w for w in words if w[0] == " " and not w[1:2].isspace() and len(w) > 1]
        blocks = [after[at : at + 500] for at in range(0, len(after), 500)]
        for some, e in zip(blocks, self.library.encode_batch_fast(["".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids, size = np.array(e.ids, "<u4"), np.cumsum([len(w.encode()) for w in some])
            reached = np.cumsum(self.lens[ids])
            ends = np.searchsorted(reached, size) + 1
            if np.array_equal(reached[ends - 1], size):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                self.table.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        rest = [w for w in words if w not in self.table]
        self.table.update(zip(rest, self._whole(rest), strict=True))
        self.table.update(zip(mixed, [b"".join(map(self.table.__getitem__, w)) for w in mixed.values()], strict=True))
        self.chars += sum(map(len, runs)) + sum(map(len, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        if self.words is None:
            return self._whole(texts)
        split = [None if any(a in t for a in self.added) else self.runs(t) for t in texts]
        new = set().union(*filter(None, split)).difference(self.table)
        if len(self.table) + len(new) > self.most or self.chars > TABLE_CHARS:
            self.table, self.chars, new = {}, 0, set().union(*filter(None, split))
        unknown = {c for c in set().union(*new) if has_unassigned(c)}
        odd = {r for r in new if not unknown.isdisjoint(r)} if unknown else set()
        self._learn(new - odd)
        whole = [i for i, runs in enumerate(split) if runs is None or odd and not odd.isdisjoint(runs)]
        found = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
        return [found[i] if i in found else b"".join(map(self.table.__getitem__, runs)) for i, runs in enumerate(split)]


def open_tokenizer(spec: str) -> Encoder:
    """A Python worker's encoder of this file, which tasks that follow one another share."""
    if hash(spec) not in _OPEN:
        _OPEN.clear()
        _OPEN[hash(spec)] = Encoder(spec)
    return _OPEN[hash(spec)]


def _grouped(sym: np.ndarray, nxt: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, pair of each place, pairs, places of each pair) of the pairs that start at ``at``, which ascends.

    Of a run of equal symbols every second place counts, from the left: a pair's places never overlap.
    """
    left, right = sym[at], sym[nxt[at]]
    same = left == right
    if same.any():
        run = at[same]
        fresh = np.r_[True, run[1:] != nxt[run[:-1]]]
        k = np.arange(len(run))
        keep = ~same
        keep[same] = (k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0
        at, left, right = at[keep], left[keep], right[keep]
    if not len(at):
        return at, at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits, low = int(max(left.max(), right.max())).bit_length(), len(at).bit_length()
    if 2 * bits + low < 64:  # one sort of numbers that end with the place is faster than a sort of places
        packed = np.sort((((left << bits) | right) << low) | np.arange(len(at)))
        key, at = packed >> low, at[packed & ((1 << low) - 1)]
    else:
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        key, at, bits = key[order], at[order], 32
    new = np.r_[True, key[1:] != key[:-1]]
    begin = np.flatnonzero(new)
    names = key[begin]
    return at, np.cumsum(new) - 1, ((names >> bits) << 32) | (names & ((1 << bits) - 1)), np.diff(np.r_[begin, len(key)])


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, symbol ends of the documents). Rule r is the nonterminal first + r and expands to its two symbols.

    Replacement goes on until no pair has two places that don't overlap. Pairs within a factor STEP of the most frequent one are
    replaced together: where places overlap the more frequent pair has it, and a pair that is left with one place is left
    alone. Symbols are linked to their neighbours, so that a round touches only the places of pairs that still repeat.
    """
    n = len(ids)
    sym = np.append(ids.astype(np.int64), -1)  # -1: no symbol; place n stands for none
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    if len(ends):
        nxt[ends - 1], prv[np.r_[0, ends[:-1]]] = n, n
    nxt[n] = prv[n] = n
    open_, mark = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    weight, owner = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    rules, made = [np.zeros((0, 2), np.int64)], 0
    while True:
        at = np.flatnonzero(open_[:n] & (sym[:n] >= 0) & (nxt[:n] < n))
        here, pair, names, counts = _grouped(sym, nxt, at)
        open_[here[counts[pair] < 2]] = False
        least = max(2, int(counts.max(initial=0)) // STEP)
        if counts.max(initial=0) < 2:
            break
        while len(here):
            # pairs that are frequent enough, heavier ones first; every place is taken or lost to a neighbour
            heavy = np.flatnonzero(counts >= least)
            rank = np.zeros(len(names), np.int64)
            rank[heavy[np.lexsort((names[heavy], counts[heavy]))]] = np.arange(1, len(heavy) + 1)
            weight[here], owner[here] = rank[pair], pair
            todo, won = here[rank[pair] > 0], []
            while len(todo):
                w = weight[todo]
                win = todo[(w > weight[prv[todo]]) & (w > weight[nxt[todo]])]
                won.append(win)
                weight[win] = weight[prv[win]] = weight[nxt[win]] = 0
                todo = todo[weight[todo] > 0]
            weight[here] = 0
            win = np.concatenate(won) if won else here[:0]
            twice = np.bincount(owner[win], minlength=len(names)) > 1
            win = win[twice[owner[win]]]
            if not len(win):
                break
            used = np.flatnonzero(twice)
            number = np.zeros(len(names), np.int64)
            number[used] = first + made + np.arange(len(used))
            rules.append(np.stack([names[used] >> 32, names[used] & 0xFFFFFFFF], axis=1))
            made += len(used)
            gone = nxt[win]
            sym[win], sym[gone] = number[owner[win]], -1
            after = nxt[gone]
            nxt[win], prv[after] = after, win
            prv[n] = n
            # pairs with a new symbol are all here, so that one which is met once is settled
            mark[win] = mark[prv[win]] = True
            mark[n] = False
            at = np.flatnonzero(mark[:n])
            mark[at] = False
            open_[at] = True
            here, pair, names, counts = _grouped(sym, nxt, at[nxt[at] < n])
            open_[here[counts[pair] < 2]] = False
    alive = sym[:n] >= 0
    return sym[:n][alive], np.concatenate(rules), np.r_[0, np.cumsum(alive)][ends]


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses only symbols before it."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        a, b = rules[todo, 0], rules[todo, 1]
        la = np.where(a < first, 1, out[np.maximum(a - first, 0)])
        lb = np.where(b < first, 1, out[np.maximum(b - first, 0)])
        ready = (la > 0) & (lb > 0)
        out[todo[ready]] = (la + lb)[ready]
        todo = todo[~ready]
    return out


def expand(sym: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """All ids of a range of symbols. Every symbol is put at its place, which the lengths before it tell, and those that are
    nonterminals are opened until none is left."""
    sym = sym.astype(np.int64)
    size = np.ones(len(sym), np.int64)
    size[sym >= first] = lengths[sym[sym >= first] - first]
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    while len(sym):
        big = sym >= first
        out[at[~big]] = sym[~big]
        at, two = at[big], rules[sym[big] - first]
        left = np.ones(len(at), np.int64)
        deep = two[:, 0] >= first
        left[deep] = lengths[two[deep, 0] - first]
        sym, at = np.concatenate([two[:, 0], two[:, 1]]), np.concatenate([at, at + left])
    return out


def symbol_bytes(top: int) -> int:
    """Bytes of a symbol below ``top``."""
    return max(1, -(-(top - 1).bit_length() // 8))


def narrow(values: np.ndarray, wide: int) -> bytes:
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def pack(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """A shard's bytes: magic; numbers of documents, symbols and rules, first nonterminal; then arrays, little-endian: doc_id
    (8 bytes) and its null flag (1), ids of each document (8), symbol end of each document (8), rules (two symbols), their
    expansion lengths (8), symbols. A symbol takes as many bytes as the highest number needs."""
    sym, rules, ends = compress(ids, np.cumsum(counts), first)
    lens, wide = rule_lengths(rules, first), symbol_bytes(first + len(rules))
    return b"".join([
        MAGIC, struct.pack("<QQQQ", len(doc_ids), len(sym), len(rules), first),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "<u1").tobytes(),
        counts.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), narrow(rules.ravel(), wide), lens.astype("<i8").tobytes(),
        narrow(sym, wide),
    ])


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, m, r, self.first = struct.unpack_from("<QQQQ", raw, 8)
        at = 40

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, k, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("<u1", n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.counts, self.ends = take("<i8", n), take("<i8", n)
        wide = symbol_bytes(self.first + r)

        def symbols(k: int) -> np.ndarray:
            out = np.zeros((k, 8), np.uint8)
            out[:, :wide] = take("<u1", k * wide).reshape(k, wide)
            return out.view("<i8").ravel()

        self.rules, self.lengths, self.symbols = symbols(2 * r).reshape(-1, 2), take("<i8", r), symbols(m)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return expand(self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]], self.rules, self.lengths, self.first)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard; only the symbols that cover them are expanded."""
        size, big = np.ones(len(self.symbols), np.int64), self.symbols >= self.first
        size[big] = self.lengths[self.symbols[big] - self.first]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = int(ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.lengths, self.first)[start - skip : stop - skip]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, at = expand(self.symbols, self.rules, self.lengths, self.first), 0
        for d, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            yield d, ids[at : at + n]
            at += n


FILE_SCHEMA = "part int, shard int, first long, n_ids long, n_docs long, payload binary"


def shard_rows(docs: DataFrame, tokenizer_path: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """The shards of ``docs`` (doc_id, text) in ascending doc_id order, as rows of FILE_SCHEMA.

    Ranges are cut by (doc_id, hash of text), so that rows which share one id spread as well.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = open_tokenizer(spec.value)
        first = tokenizer.library.get_vocab_size(with_added_tokens=True)
        part, shard, done = TaskContext.get().partitionId(), 0, 0
        end, names, held, size = np.array([end_id], "<u4").tobytes(), [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard, done, names, held, size
            counts = np.array([len(h) // 4 for h in held], np.int64)
            payload = pack(names, np.frombuffer(b"".join(held), "<u4"), counts, first)
            row = [part, shard, done, int(counts.sum()), len(names), payload]
            shard, done, names, held, size = shard + 1, done + int(counts.sum()), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                for d, raw in zip(some.column(0).to_pylist(), tokenizer.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    names.append(d)
                    held.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= SHARD_IDS:
                        yield close()
        if names:
            yield close()

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(count, F.col("doc_id").asc_nulls_first(), "_h")
    return dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "text").select("doc_id", "text").mapInArrow(write, FILE_SCHEMA)


def write_token_file(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 0) -> None:
    """Write the ids of all documents to ``out_path``."""
    shard_rows(docs, tokenizer_path, end_id).write.mode("overwrite").parquet(out_path)


def read_token_file(shards: DataFrame) -> DataFrame:
    """One row for each document of a file: doc_id, start (ids before it), n_tokens, ids_crc32, all from the decoded shards.

    The ids before each part are summed over one row for each part, a number fixed by the writer; that table is broadcast.
    """
    from pyspark.sql import Window

    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = shards.join(F.broadcast(before), "part").select((F.col("before") + F.col("first")).alias("at"), "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, starts, sizes, crcs = [], [], [], []
                for d, tokens in Shard(raw.as_py()).documents():
                    ids.append(d)
                    starts.append(at)
                    sizes.append(len(tokens))
                    crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    at += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, starts, sizes, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write a token file into the shared folder and read every document back from it."""
    scratch = Scratch(docs.sparkSession, "tokenfile")
    return read_token_file(scratch.keep(shard_rows(docs, tokenizer_path, end_id)))
