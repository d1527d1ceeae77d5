"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join over binary tries.

A fingerprint links with another if they differ in at most ``budget`` bits. Two such fingerprints agree on at least one of
``budget + 1`` or more equal blocks of their bits, so the search is dealt out by block: under the key (block, its value)
lies a trie. Each task holds the tries of its keys and walks pairs of trie nodes together, one bit
a level, adding differing bits and dropping a pair of nodes once the budget is exceeded. A key that holds many
fingerprints (a large group of near copies) is cut by further bits into subtries, and its pairs of subtries are tasks of
their own. A task returns a spanning forest of the links that it finds, never all pairs, and components are then
computed over distinct fingerprints.

Null texts count as empty; a text without words has fingerprint zero and links like any other. Repeated rows and null ids
keep their rows; a component without any id has a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, unused
from tidemark.llm.components import component_labels

SEED, BITS = 42, 64
#: A key with more fingerprints than HOT_KEY is cut into subtries by the first of the bits SUB_AT, as many as bring it below.
HOT_KEY, SUB_AT = 4096, (5, 21, 37, 53, 13, 29, 45, 61, 1, 17, 33, 49)
MOST_SUB_BITS = len(SUB_AT)
#: Rows of whole keys that a task walks at once.
WALK_ROWS = 400_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a whole text as a signed 64-bit number.

    A-Z become lower case, words end at ASCII white space, shingles are ``width`` words joined by blanks with repeats.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= width:
        grams = [b" ".join(words)]
    else:
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[:-1]]
        grams = [line[a : b - 1] for a, b in zip(starts, ends[width - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: Column, width: int = 4) -> Column:
    """A column with the signed fingerprint of each whole text."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of(text)


def plan_blocks(n: int, budget: int, per_key: int = 64) -> tuple[int, int]:
    """(blocks, agreeing): the fewest blocks such that keys of agreeing blocks hold ``per_key`` of n random prints or fewer.

    Of ``blocks`` equal blocks, at least blocks - budget agree; every such choice of blocks is a key.
    """
    for blocks in range(budget + 1, budget + 5):
        agree = blocks - budget
        if n / 2.0 ** (agree * (BITS // blocks)) <= per_key:
            return blocks, agree
    return budget + 4, 4


def block_masks(blocks: int, agree: int) -> list[int]:
    from itertools import combinations

    cut = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), agree)]


class Forest:
    """Union-find over positions, joined in numpy batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            nxt = self.root[r]
            if np.array_equal(nxt, r):
                return r
            r = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            open_ = hi > lo
            a, b, hi, lo = a[open_], b[open_], hi[open_], lo[open_]
            np.minimum.at(self.root, hi, lo)
            self.root = self.root[self.root]


def trie_links(prints: np.ndarray, roots: list[tuple[np.ndarray, np.ndarray]], budget: int, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between leaves under the given pairs of tries.

    ``prints`` is a flat array of unsigned fingerprints. Each root is a pair of sorted position arrays, which may be the same
    array. Nodes are ranges of the sorted order; a pair of nodes carries the bits by which their paths differ so far. A
    stack holds the pairs still to be walked, depth first in chunks, so memory is bounded by levels times chunk.
    """
    order = np.concatenate([np.concatenate(r) if r[0] is not r[1] else r[0] for r in roots]) if roots else np.zeros(0, np.int64)
    keys, starts, at = prints[order], [], 0
    for left, right in roots:
        same = left is right
        starts.append((at, at + len(left), at if same else at + len(left), at + len(left) if same else at + len(left) + len(right)))
        at = starts[-1][3]
    forest = Forest(len(prints))
    first = np.array(starts, np.int64).reshape(-1, 4)
    stack = [(0, first[:, 0], first[:, 1], first[:, 2], first[:, 3], np.zeros(len(first), np.int64))]
    one = np.uint64(1)
    levels: dict[int, np.ndarray] = {}  # by level: how many of the order's first keys have that bit set
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > chunk:
            stack.append((level, a0[chunk:], a1[chunk:], b0[chunk:], b1[chunk:], err[chunk:]))
            a0, a1, b0, b1, err = (x[:chunk] for x in (a0, a1, b0, b1, err))
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            far = np.bitwise_count(keys[x] ^ keys[y])
            near = (far <= budget) & (x != y)
            forest.join(order[x[near]], order[y[near]])
            a0, a1, b0, b1, err = (v[~single] for v in (a0, a1, b0, b1, err))
        if not len(a0) or level == BITS:
            if len(a0):  # equal fingerprints in one trie
                forest.join(order[a0], order[b0])
            continue
        if level not in levels:
            bit = ((keys >> np.uint64(BITS - 1 - level)) & one).astype(np.int64)
            levels[level] = np.concatenate([[0], np.cumsum(bit)])
        ones = levels[level]
        # within a node's range the order is by bits, so the zero side comes first
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        nxt = []
        for la, ha, lb, hb, cost, once in ((a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True)):
            ok = (ha > la) & (hb > lb) & (err + cost <= budget)
            if once:
                ok &= ~same
            nxt.append((la[ok], ha[ok], lb[ok], hb[ok], err[ok] + cost))
        la, ha, lb, hb, e = (np.concatenate(v) for v in zip(*nxt, strict=True))
        lone = (la == lb) & (ha - la == 1) & (hb - lb == 1)
        keep = ~lone
        # all leaves of both nodes in one tree already: nothing to gain below
        small = keep & (ha - la + hb - lb <= 8)
        if small.any():
            r = forest.find(order)
            i = np.flatnonzero(small)
            keep[i[(ha[i] - la[i] == 1) & (hb[i] - lb[i] == 1) & (r[la[i]] == r[lb[i]])]] = False
        if keep.any():
            stack.append((level + 1, la[keep], ha[keep], lb[keep], hb[keep], e[keep]))
    child = np.flatnonzero(forest.root != np.arange(len(prints)))
    return child, forest.find(child)


def _whole_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that hold every row of their keys, of some WALK_ROWS rows or one larger key; rows come in the order of keys."""
    held, size, most = [], 0, WALK_ROWS
    for f in frames:
        held.append(f)
        size += len(f)
        if size < most:
            continue
        rows = pd.concat(held, ignore_index=True)
        names = rows[["mask", "key", "sub"]].to_numpy()
        cut = int(np.flatnonzero((names != names[-1]).any(axis=1))[-1]) + 1 if (names[0] != names[-1]).any() else 0
        if cut:
            yield rows.iloc[:cut]
        held, size = [rows.iloc[cut:]], len(rows) - cut
        most = max(WALK_ROWS, 2 * size)
    if size:
        yield pd.concat(held, ignore_index=True)


def _walk(budget: int):
    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_keys(frames):
            yield from walk(rows)

    def walk(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        mask, key, sub, fp, side = (rows[c].to_numpy() for c in ("mask", "key", "sub", "fp", "side"))
        prints = fp.astype(np.int64).view(np.uint64)
        order = np.lexsort((prints, side, sub, key, mask))
        m, k, s, d = mask[order], key[order], sub[order], side[order]
        new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        ends = np.r_[new[1:], len(order)]
        roots = []
        for a, b in zip(new, ends, strict=True):
            sides = d[a:b]
            cut = a + int(np.searchsorted(sides, 1))
            if cut == b:
                if b - a > 1:
                    roots.append((order[a:b],) * 2)
            elif cut > a:
                roots.append((order[a:cut], order[cut:b]))
        for at in range(0, len(roots), 4096):
            part = roots[at : at + 4096]
            used = np.unique(np.concatenate([np.concatenate(r) for r in part]))
            back = [(np.searchsorted(used, r[0]), None if r[0] is r[1] else np.searchsorted(used, r[1])) for r in part]
            child, parent = trie_links(prints[used], [(x, x if y is None else y) for x, y in back], budget)
            one = prints[used].view(np.int64)
            differ = one[child] != one[parent]
            yield pd.DataFrame({"a": one[child][differ], "b": one[parent][differ]}).drop_duplicates()

    return tasks


def fingerprint_links(distinct: DataFrame, scratch: Scratch, budget: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: a spanning forest for each task, whose union has the components
    of all pairs that differ in at most ``budget`` bits. Exact at every size."""
    n = distinct.count()
    masks = block_masks(*plan_blocks(n, budget))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask"))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    many = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY)
    deep = F.least(F.lit(MOST_SUB_BITS), F.ceil(F.log2(F.col("n") / HOT_KEY))).cast("int")
    hot = scratch.keep(many.select("mask", "key", deep.alias("deep")))
    # a hot key's tries are cut by spread bits, so that near copies part; (p, q) stands for a pair of subtries within the budget
    path = sum((F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)) * (1 << i) for i, b in enumerate(SUB_AT)), F.lit(0)).cast("int")
    p = path.bitwiseAND(F.expr("shiftleft(1, deep) - 1"))
    others = F.filter(F.sequence(F.lit(0), F.expr("shiftleft(1, deep) - 1")), lambda q: F.bit_count(q.bitwiseXOR(p)) <= budget)
    cut = keyed.join(hot, ["mask", "key"], "left").withColumn("p", F.coalesce(p, F.lit(0)))
    cut = cut.withColumn("q", F.explode(F.when(F.col("deep").isNull(), F.array(F.lit(0))).otherwise(others)))
    sub = F.least("p", "q") * (1 << MOST_SUB_BITS) + F.greatest("p", "q")
    tasks = cut.select("mask", "key", sub.alias("sub"), "fp", (F.col("p") > F.col("q")).cast("int").alias("side"))
    dealt = tasks.repartition("mask", "key", "sub").sortWithinPartitions("mask", "key", "sub")
    return dealt.mapInPandas(_walk(budget), "a long, b long").distinct()


def _grouped(docs: DataFrame, width: int, budget: int, text: str) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeper) of each document; keeper is the first (doc_id, text_hash) of its group."""
    scratch = Scratch(docs.sparkSession, "simhash")
    # known ids come before null ones; the smallest id of a group is that of its first document
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    prints = scratch.keep(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), fingerprints(F.col(text), width).alias("fp")))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min(place).alias("least")))
    links = scratch.keep(fingerprint_links(distinct.select("fp"), scratch, budget))
    labels = scratch.keep(component_labels(links, scratch))
    scratch.drop(links)
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    firsts = named.groupBy("label").agg(F.min("least").alias("keeper"))
    final = scratch.keep(named.join(firsts, "label").select(F.col("fp").alias("_fp"), "keeper"))
    scratch.drop(labels)
    scratch.drop(distinct)
    return prints.join(final, prints.fp == final["_fp"]).select("doc_id", "text_hash", "fp", F.col("keeper.doc_id").alias("component_id"), place.eqNullSafe(F.col("keeper")).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, text: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return _grouped(docs, width, budget, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5, budget: int = 4) -> DataFrame:
    """The first document of each group, by doc_id and then hash of text; of rows that repeat it, one. All columns stay."""
    key, text_key = unused(docs, "id", "hash")
    kept = _grouped(docs, width, budget, "text").where("first").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_key))
    found = docs.join(kept, same, "left_semi")
    repeats = found.groupBy("doc_id", F.xxhash64("text").alias(text_key)).agg(F.count(F.lit(1)).alias(key)).where(F.col(key) > 1).limit(1).count()
    return found.dropDuplicates(["doc_id", "text"]) if repeats else found
