"""Best-fit packing of token sequences after Martello-Toth reduction.

Every document is encoded whole and ended by an end id; documents longer than ``capacity`` are cut from their end, so that only the
first piece may be shorter. What the packing needs to know of the pieces is how many there are of each length, which Spark counts: a
table of at most ``capacity`` rows, whatever the corpus. On it ``plan`` works with whole groups of equal pieces:

1. *Reduction.* For the longest piece j, a set of at most three pieces that dominates every other feasible set with j is fixed as a
   sequence, for as many copies as there are: j alone if nothing fits beside it; j and the longest piece that fits, if no
   two others fit or the two fill the sequence or outweigh the best two others; j and two others, if no feasible pair beats them
   piece by piece. No packing of all pieces needs fewer sequences than the best one that holds the fixed sets.
2. *Best fit.* The remainder goes, longest first, into the sequence with the least room that takes it.

The plan says which ranks among the pieces of one length go to which sequences. A piece's rank is its place among its task's pieces of
that length plus the pieces of that length in the tasks before: no group of equal lengths is gathered anywhere.

Null texts count as empty (the end id alone). Repeated rows and null ids are rows like others. Extra columns are ignored. No rows: no
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.tokenfile import open_tokenizer

#: Fields of a run: pieces of ``length`` with the ranks ``rank`` and ``n`` that follow go to sequences from ``sequence``, ``per`` to
#: each, the first of them at ``offset``.
RUN = ("length", "rank", "n", "sequence", "per", "offset")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def dominating_set(left: np.ndarray, w: int) -> list[int] | None:
    """The lengths beside a piece of length ``w`` in a set that dominates all others with it; None where the rule finds none.

    ``left[x]`` pieces of length x are there, the piece itself among them.
    """
    room = len(left) - 1 - w
    left = left.copy()
    left[w] -= 1
    there = np.flatnonzero(left[: room + 1])
    if not len(there):
        return []
    # how many of the smallest pieces fit, up to three
    few = np.repeat(there[:3], np.minimum(left[there[:3]], 3))[:3]
    k = int((np.cumsum(few) <= room).sum())
    top = int(there[-1])
    if k == 1 or top == room:
        return [top]
    if k > 2:
        return None
    # the heaviest pair that fits: for each length the longest partner, which is another piece
    partner = np.searchsorted(there, room - there, "right") - 1
    partner = np.minimum(partner, np.arange(len(there)))
    alone = (partner == np.arange(len(there))) & (left[there] < 2)
    partner = partner - alone
    ok = partner >= 0
    sums = np.where(ok, there + there[np.maximum(partner, 0)], -1)
    # of equally heavy pairs the one with the longest piece
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    a, b = int(there[best]), int(there[partner[best]])
    if top >= a + b:
        return [top]
    if a != top:
        return None
    # no two pieces longer than b fit together beside w, the one of length a left out
    left[a] -= 1
    over = np.flatnonzero(left[b + 1 : room + 1]) + b + 1
    two = np.repeat(over[:2], np.minimum(left[over[:2]], 2))[:2]
    return [a, b] if len(two) < 2 or int(two.sum()) > room else None


def reduce(counts: np.ndarray) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """(sets that are fixed with how often each, counts of what is left) of ``counts`` by length, 0 to capacity."""
    left, fixed = counts.astype(np.int64), []
    for w in range(len(left) - 1, 0, -1):
        while left[w]:
            beside = dominating_set(left, w)
            if beside is None:
                break
            need = np.bincount([w, *beside], minlength=len(left))
            used = np.flatnonzero(need)
            times = int((left[used] // need[used]).min())
            left -= times * need
            fixed.append(([w, *beside], times))
    return fixed, left


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(runs, sequences): where the pieces go, ``counts[x]`` of each length x up to the capacity. The columns of runs are RUN.

    The work and the number of runs depend on the capacity, not on how many pieces there are.
    """
    capacity = len(counts) - 1
    fixed, left = reduce(counts)
    used, runs, made = np.zeros(capacity + 1, np.int64), [], 0

    def put(w: int, n: int, sequence: int, per: int, offset: int) -> None:
        runs.append((w, int(used[w]), n, sequence, per, offset))
        used[w] += n

    open_: dict[int, list[tuple[int, int]]] = {}  # room: groups of sequences (first, how many)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_.get(room):
                heappush(rooms, room)
            open_.setdefault(room, []).append((first, n))

    for lengths, times in fixed:
        at = 0
        for w in lengths:
            put(w, times, made, 1, at)
            at += w
        leave(capacity - at, made, times)
        made += times
    for w in range(capacity, 0, -1):
        n, aside = int(left[w]), []
        while n:
            while rooms and (rooms[0] < w or not open_[rooms[0]]):
                room = heappop(rooms)
                if open_[room]:
                    aside.append(room)
            if rooms:
                room = rooms[0]
                first, have = open_[room].pop()
            else:
                room, first = capacity, made
                have = -(-n // (capacity // w))
                made += have
            per, at = room // w, capacity - room
            whole = min(n // per, have)
            rest = n - whole * per if whole < have else 0
            put(w, whole * per + rest, first, per, at)
            n -= whole * per + rest
            leave(room, first + whole + (rest > 0), have - whole - (rest > 0))
            leave(room - per * w, first, whole)
            if rest:
                leave(room - rest * w, first + whole, 1)
        for room in aside:
            heappush(rooms, room)
    return np.array(runs, np.int64).reshape(-1, len(RUN)), made


def least_sequences(counts: np.ndarray) -> int:
    """A bound that no packing goes below: tokens by capacity, or for some x the pieces that can't share a sequence and what
    the pieces of at least x need beyond their room (Martello and Toth's L2)."""
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    tokens, best = lengths * counts, 0
    best = -(-int(tokens.sum()) // capacity)
    for x in range(1, capacity // 2 + 1):
        big, large = slice(capacity - x + 1, None), slice(capacity // 2 + 1, capacity - x + 1)
        room = int((counts[large] * (capacity - lengths[large])).sum())
        small = int(tokens[x : capacity // 2 + 1].sum())
        best = max(best, int(counts[big].sum() + counts[large].sum()) + max(0, -(-(small - room) // capacity)))
    return best


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece of each document, PIECES: ``part`` is the task, ``rank`` the piece's place among those of its length there."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = open_tokenizer(spec.value), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some, rows = batch.slice(at, 128), []
                for d, raw in zip(some.column(0).to_pylist(), tokenizer.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids = memoryview(raw + end)
                    n = len(ids) // 4
                    start, length = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        rows.append((d, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                        start, length = start + length, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` (columns of PIECES, and any others) is read twice and has to be a kept table."""
    held = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("_before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    runs, _ = plan(counts)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    top = int(counts.max(initial=0)) + 1
    shared = pieces.sparkSession.sparkContext.broadcast((runs, runs[:, 0] * top + runs[:, 1]))
    joined = pieces.join(held, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    names = [c for c in pieces.columns if c not in ("part", "rank")]
    schema = pieces.select(*names).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, keys = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            run = runs[np.searchsorted(keys, length * top + rank, "right") - 1]
            ahead = rank - run[:, 1]
            sequence, offset = run[:, 3] + ahead // run[:, 4], run[:, 5] + ahead % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=schema.names)

    return joined.select(*names, (F.col("_before") + F.col("rank")).alias("_rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return place_pieces(scratch.keep(cut_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
