"""Benchmark decontamination by latent semantic retrieval.

Documents become word ids over the benchmark's vocabulary (a word of no item can't bring a passage nearer to one). Passages are
windows of two blocks of ``BLOCK`` words, each overlapping the next by half; words weigh by their inverse block frequency,
counted over all documents, less that of a word in a share ``STOP`` of blocks; commoner words weigh nothing, unless an item
consists of them alone. A randomised SVD (one pass over all passages, Nystroem form: Z = A'AO for
a random O) gives the latent space. Then every document is searched:

1. All its passages are compared with all items by cosine in the latent space; ``COSINE`` or more makes a candidate, and so
   does ``FAINT`` or more where the passage's projection on the item is ``SHARE`` of the item's length or more, as that of a
   short item among other rare words. The passage's summed squared weights must reach ``COVER`` of the item's: below that
   it can't hold that share of the item.
2. A candidate is verified on the words around the passage: the longest common subsequence with the item in a stretch half as
   long again as the item, as a share of the item. ``COPY`` or more is a copy; ``PARAPHRASE`` or more is a paraphrase if the item's answer (its last sentence) is there
   too, by a share of ``ANSWER`` of its words in order.

Items longer than a passage are looked for by pieces of BLOCK words. The benchmark is taken in blocks of bounded size, which
are collected and broadcast. Null or wordless texts match nothing; null item ids are kept. Repeated rows match alike.
Extra columns are ignored. An empty benchmark or table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, unused

BLOCK, RANK, OVERSAMPLE, STOP = 24, 64, 16, 0.02
COVER, COSINE, FAINT, SHARE, COPY, PARAPHRASE, ANSWER = 0.3, 0.35, 0.15, 0.4, 0.6, 0.45, 0.8
#: Characters of benchmark text that are searched for at once.
ITEM_CHARS = 4_000_000
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?]+\s")
#: Words, passages and pieces of items that are worked on at once, which bounds a task's memory.
_CHUNK, _PASSAGES, _PIECES = 40_000, 4096, 4096


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def answer_of(text: str) -> str:
    """The last sentence of an item that has words."""
    return next((s for s in reversed(_SENTENCE.split(text)) if _WORD.search(s)), "")


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two id arrays; ids of 0 match nothing. One step for each id of b, over the
    bits of one number for all of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        if x:
            places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = places.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def best_lcs(a: np.ndarray, b: np.ndarray) -> int:
    """The longest common subsequence of a with any stretch of b half as long again as a, in steps of a quarter of a.

    Common words alone make up a long subsequence over a long stretch; an item or its paraphrase stands close together.
    """
    size, step = len(a) + len(a) // 2 + 1, max(len(a) // 4, 1)
    return max((lcs(a, b[i : i + size]) for i in range(0, max(len(b) - size, 0) + step, step)), default=0)


class Items:
    """A block of the benchmark: vocabulary, ids of items, answers and search pieces."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        rows = [(i, t) for i, t in rows if words_of(t)]
        self.ids = [i for i, _ in rows]
        self.vocab: dict[str, int] = {}
        number = lambda text: np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int64)
        self.words = [number(t) for _, t in rows]
        self.answers = [number(answer_of(t)) for _, t in rows]
        self.pieces, self.piece_of = [], []
        for k, w in enumerate(self.words):
            cuts = range(0, len(w), BLOCK) if len(w) > 2 * BLOCK else [0]
            for a in cuts:
                part = w[a : a + (BLOCK if len(w) > 2 * BLOCK else len(w))]
                if a == 0 or len(part) >= BLOCK // 2:
                    self.pieces.append(part)
                    self.piece_of.append(k)
        self.piece_of = np.array(self.piece_of, int)


def _ids_type(size: int) -> str:
    return "<u2" if size < 1 << 16 else "<u4"


def word_ids(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, text_hash, ids binary): the words of each whole text; 0 for words of no item."""
    vocab, kind = docs.sparkSession.sparkContext.broadcast(items.vocab), _ids_type(len(items.vocab) + 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocab.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some, out = batch.slice(at, 128), []
                for text in some.column(2).to_pylist():
                    out.append(np.array([get(w, 0) for w in words_of(text)], kind).tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.binary())], names=["doc_id", "text_hash", "ids"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(number, "doc_id long, text_hash long, ids binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each document ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return values.view(kind), (offsets[1:] - offsets[0]) // size


def _distinct(groups: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, id) of groups that don't descend, in order. Groups are taken relative to the first, so that keys are
    short numbers, which sort several times faster."""
    low = int(groups[0]) if len(groups) else 0
    narrow = len(groups) and (int(groups[-1]) - low + 1) << bits < 1 << 31
    key = ((groups - low).astype(np.int32 if narrow else np.int64) << bits) | ids.astype(np.int32 if narrow else np.int64)
    key = np.sort(key)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> bits).astype(np.int64) + low, (key & ((1 << bits) - 1)).astype(np.int64)


def _blocks(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents that end at ``ends``: each document's first block, and the number of blocks before each word."""
    lens = np.diff(np.r_[0, ends])
    count = -(-lens // BLOCK)
    return np.cumsum(count) - count, count


def _word_blocks(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each word of a batch, each document's first block and number of blocks."""
    lens = np.diff(np.r_[0, ends])
    first, count = _blocks(ends)
    doc = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(doc)) - np.repeat(ends - lens, lens)
    return first[doc] + place // BLOCK, first, count


def passage_weights(words: DataFrame, size: int, kind: str) -> np.ndarray:
    """Inverse frequency of each id over the blocks of all documents: log((1 + blocks) / (1 + blocks with the word))."""

    bits = size.bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(size, np.int64), 0
        for batch in batches:
            ids, ends = _flat(batch.column(0), kind)
            if not len(ids):
                continue
            at, _, number = _word_blocks(ends)
            blocks += int(number.sum())
            known = ids > 0
            some, where = ids[known], at[known]
            for a in range(0, len(some), _CHUNK):
                # a block that a cut divides counts once: the cut moves to where a block ends
                lo, hi = (np.searchsorted(where, where[min(c, len(some) - 1)]) if c < len(some) else len(some) for c in (a, a + _CHUNK))
                total += np.bincount(_distinct(where[lo:hi], some[lo:hi], bits)[1], minlength=size)
        total[0] = blocks
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    got = words.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size)
    n[got["id"].to_numpy(int)] = got["n"].to_numpy(float)
    weight = np.log((1 + n[0]) / (1 + n))
    weight[0] = 0
    return np.maximum(weight, 0)


def _passages(ids: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct known words of each passage number in ``at``: (passage, id, weight), by passage."""
    keep = weight[ids] > 0
    passage, word = _distinct(at[keep], ids[keep], len(weight).bit_length())
    return passage, word, weight[word]


def latent_space(words: DataFrame, weight: np.ndarray, kind: str, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Right singular vectors (ids, rank) of all passages' unit vectors, by a randomised one-pass range finder."""
    spark, size, width = words.sparkSession, len(weight), rank + OVERSAMPLE
    omega = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    shared = spark.sparkContext.broadcast((weight.astype(np.float32), omega))
    columns = [f"z{j}" for j in range(width)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, omega = shared.value
        z = np.zeros((size, width), np.float32)
        for batch in batches:
            ids, ends = _flat(batch.column(0), kind)
            if not len(ids):
                continue
            at, first, _ = _word_blocks(ends)
            doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            pair = first[doc] + (at - first[doc]) // 2  # two blocks of a document are a passage; numbers stay apart
            for a in range(0, len(ids), _CHUNK):
                passage, word, w = _passages(ids[a : a + _CHUNK], pair[a : a + _CHUNK], weight)
                if not len(word):
                    continue
                start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                norm = np.sqrt(np.add.reduceat(w * w, start))
                w = w / np.repeat(norm, np.diff(np.r_[start, len(w)]))
                y = np.add.reduceat(omega[word] * w[:, None], start)
                owner = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(w)]))
                order = np.argsort(word, kind="stable")
                begin = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
                z[word[order][begin]] += np.add.reduceat(y[owner[order]] * w[order][:, None], begin)
        met = np.flatnonzero(z.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *[pa.array(z[met, j].astype(float)) for j in range(width)]], names=["id", *columns])

    # a row for each word of a task; their sums are added up like any aggregate, and no group is gathered
    rows = words.select("ids").mapInArrow(gather, ", ".join(["id int", *[f"{c} double" for c in columns]]))
    got = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    z = np.zeros((size, width))
    z[got["id"].to_numpy(int)] = got[columns].to_numpy(float)
    # A'A ~ Z (O'Z)^-1 Z'; a small shift keeps the inverse tame
    shift = 1e-6 * max(np.linalg.norm(z), 1e-12)
    z = z + shift * omega
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-30)
    half = z @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :rank].astype(np.float32)


def _candidates(x: np.ndarray, norm: np.ndarray, energy: np.ndarray, mass: np.ndarray, latent: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, piece, cosine) of the pairs that are worth a look, piece by piece in blocks."""
    for at in range(0, len(latent), _PIECES):
        some = slice(at, at + _PIECES)
        dot = x @ latent[some].T
        cosine = dot / norm
        near = ((cosine >= COSINE) | ((cosine >= FAINT) & (dot >= SHARE * length[some]))) & (energy[:, None] >= COVER * mass[some])
        for i, k in zip(*np.nonzero(near), strict=True):
            yield int(i), at + int(k), float(cosine[i, k])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, verdict, lcs_share, answer_share, cosine): one row for each document and item that meet."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontam")
    schema = "doc_id long, text_hash long, item_id long, verdict string, lcs_share double, answer_share double, cosine double"
    chars = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks, found = max(1, -(-chars // ITEM_CHARS)), None
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        items = Items([(r[0], r[1]) for r in rows])
        if items.ids:
            one = _search(docs, items, scratch, schema)
            found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found


def _search(docs: DataFrame, items: Items, scratch: Scratch, schema: str) -> DataFrame:
    size, kind = len(items.vocab) + 1, _ids_type(len(items.vocab) + 1)
    words = scratch.keep(word_ids(docs, items))
    weight = passage_weights(words, size, kind)
    unique = [np.unique(p) for p in items.pieces]
    above = np.maximum(weight + np.log(STOP), 0)
    floor = 0.0 if all(above[u].any() for u in unique) else 0.1
    weight = np.maximum(above, np.where(weight > 0, floor, 0))
    space = latent_space(words, weight, kind)
    mass = np.array([(weight[u] ** 2).sum() for u in unique])
    latent = np.stack([weight[u] @ space[u] for u in unique])
    length = np.maximum(np.linalg.norm(latent, axis=1), 1e-12).astype(np.float32)
    latent /= length[:, None]
    items.vocab = {}
    shared = docs.sparkSession.sparkContext.broadcast((items, weight, space, mass, latent.astype(np.float32), length))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, space, mass, latent, length = shared.value
        square, loaded = (weight**2).astype(np.float32), (space * weight[:, None]).astype(np.float32)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            ids, ends = _flat(batch.column(2), kind)
            if not len(ids):
                continue
            at, first, count = _word_blocks(ends)
            owner = np.repeat(np.arange(len(ends)), count)
            heavy = square[ids] > 0
            known, block = ids[heavy], at[heavy]
            best: dict[tuple[int, int], tuple] = {}
            for lo in range(0, len(owner), _PASSAGES):
                # blocks lo..hi and the one behind, for the passage that reaches into it
                hi = min(lo + _PASSAGES, len(owner))
                a, z = np.searchsorted(block, [lo, hi + 1])
                x, energy = np.zeros((hi + 1 - lo, space.shape[1]), np.float32), np.zeros(hi + 1 - lo, np.float32)
                for c in range(a, z, _CHUNK):
                    some, here = known[c : min(c + _CHUNK, z)], block[c : min(c + _CHUNK, z)] - lo
                    start = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                    x[here[start]] += np.add.reduceat(loaded[some], start)
                    energy[here[start]] += np.add.reduceat(square[some], start)
                pair = np.flatnonzero(owner[lo : min(hi, len(owner) - 1)] == owner[lo + 1 : min(hi, len(owner) - 1) + 1])
                alone = np.flatnonzero(count[owner[lo:hi]] == 1)
                x[pair], energy[pair] = x[pair] + x[pair + 1], energy[pair] + energy[pair + 1]
                places = np.sort(np.r_[pair, alone])
                x, energy = x[places], energy[places]
                norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for i, piece, near in _candidates(x, norm, energy, mass, latent, length):
                    b, k = int(places[i]) + lo, int(items.piece_of[piece])
                    d = int(owner[b])
                    begin, end = (int(ends[d - 1]) if d else 0), int(ends[d])
                    s = begin + (b - int(first[d])) * BLOCK
                    w, answer = items.words[k], items.answers[k]
                    around = ids[max(begin, s - len(w)) : min(end, s + 2 * BLOCK + len(w))]
                    share = lcs(w, around) / len(w)
                    share = best_lcs(w, around) / len(w) if share >= PARAPHRASE else 0
                    if share < PARAPHRASE or (d, k) in best and share <= best[d, k][1]:
                        continue
                    told = lcs(answer, around) / max(len(answer), 1)
                    verdict = "copy" if share >= COPY else "paraphrase" if told >= ANSWER else None
                    if verdict:
                        best[d, k] = (verdict, share, told, near)
            if best:
                who = [d for d, _ in best]
                columns = [batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array([items.ids[k] for _, k in best], pa.int64())]
                columns += [pa.array(v, t) for v, t in zip(zip(*best.values(), strict=True), (pa.string(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return words.mapInArrow(search, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, verdict, lcs_share, answer_share, cosine) of every document that holds an item, and no other."""
    return find_leaks(docs, benchmark).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark; all columns stay. Rows are matched by doc_id and text."""
    scratch = Scratch(docs.sparkSession, "decontam")
    key, text_key = unused(docs, "id", "hash")
    hit = scratch.keep(find_leaks(docs, benchmark).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key)).distinct())
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left_anti")
