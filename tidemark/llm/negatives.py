"""Hard negatives by one-dimensional distance keys.

Vectors are quantised to integers, and a row's score is its inner product with the anchor. One more coordinate, the root of what its
square length lacks to the largest one, turns the largest product into the smallest distance: |q|^2 + M^2 - 2 q.x is the squared distance
of (q, 0) and the augmented x. Every augmented vector belongs to its nearest pivot and is stored sorted by (pivot, distance), cut
into blocks: an annulus of one pivot each. A query's distance to the pivot bounds its distance to all rows of an annulus from
both sides. A search takes the annuli in the order of those bounds, a few first and eight times as many in each round, and ends
for a query when the bound of what remains is beyond the worst of the k rows that it holds. So results are exact.

Two searches answer a query: the best rows of the same label, then, for each positive's score, the best rows of other labels within
the window that the score sets. Rows of one label with equal vectors are one class that keeps its smallest ids, as many as could be
among the best, so a group of copies of any size is scanned once; anchors of one class share its searches.

Only the pivots come from a sample (``SAMPLE`` classes, the smallest hashes). Rows with a null id, label, vector or component, or one
that isn't finite, take no part. Rows that repeat id, label and vector count once; rows that share an id only are rows of their own, but
never the positives of each other. Components that a shorter vector lacks count as zero. Scores are exact as long as they fit
a long. Extra columns are ignored. No rows, or no anchors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Most rows of an annulus, most pivots, classes that pivots are chosen from, and most annuli whose bounds are broadcast at once.
BLOCK, PIVOTS, SAMPLE, DIRECTORY = 2048, 64, 8192, 1 << 18
#: Queries that meet an annulus together, and tasks' worth of them that share one copy of it.
GROUP, SHARED = 256, 512
#: Annuli of a query's first round, and how many times as many the next one has.
FIRST, GROWTH = 4, 8
_NONE, _ALL = -(1 << 62), 1 << 62


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(v, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def label_classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cls, label, v, ids): rows of one label with equal vectors, with their ``keep`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    least = rows.distinct().withColumn("_place", place).where(F.col("_place") <= keep)
    found = least.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return found.select(F.monotonically_increasing_id().alias("cls"), "label", "v", "ids")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Integer vectors as rows, short ones filled up with zeros."""
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d) < size[:, None]] = column.flatten().to_numpy()
    return out


class Space:
    """Augmented vectors and their pivots; all numbers that a task needs."""

    def __init__(self, d: int, largest: float, top: int, sample: np.ndarray, n: int):
        self.d, self.largest = d, largest
        self.kind = next((k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31)) if top < most), "<i8")
        self.exact = largest < 2**52  # then sums of products are exact in doubles
        x, rng = self.augmented(sample), np.random.default_rng(5)
        k = max(1, min(PIVOTS, n // 1024, len(x)))
        pivots = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8 if k > 1 else 0):
            near = self.distances(x, pivots).argmin(axis=1)
            for j in np.unique(near):
                pivots[j] = x[near == j].mean(axis=0)
        self.pivots = pivots

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    @staticmethod
    def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
        return np.sqrt(np.maximum(square, 0))

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.d).astype(float if self.exact else np.int64)

    def score_bounds(self, q: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that a row of each annulus can have with each query, with room for rounding."""
        own = (q.astype(float) ** 2).sum(axis=1)[:, None] + self.largest
        room = 1e-6 * np.sqrt(own) + 1e-6
        away = self.distances(np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1), self.pivots)[:, pivot]
        near = np.maximum(np.maximum(away - hi, lo - away) - room, 0)
        far = away + hi + room
        return np.floor((own - far**2) / 2) - 1, np.ceil((own - near**2) / 2) + 1


def build_space(classes: DataFrame) -> Space | None:
    length = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    top = F.aggregate("v", F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e.cast("double"))))
    n, d, largest, most = classes.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(length), F.max(top)).first()
    if not n:
        return None
    d = max(d, 1)
    got = classes.select("v").orderBy(F.xxhash64("label", "v")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    return Space(d, largest, int(most), _matrix(got, d), n)


def build_blocks(classes: DataFrame, space: Space, scratch: Scratch) -> DataFrame:
    """Every class in an annulus: (block, pivot, lo, hi, x, labels, ids, n_ids), rows in the order of their smallest ids."""
    shared = classes.sparkSession.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), space.d)
            away = space.distances(space.augmented(x), space.pivots)
            pivot = away.argmin(axis=1)
            packed = [r.tobytes() for r in x.astype(space.kind)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(away[np.arange(len(x)), pivot]), *(batch.column(c) for c in ("cls", "label", "ids")), pa.array(packed, pa.binary())], names=["pivot", "dist", "cls", "label", "ids", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]

        def close() -> pa.RecordBatch:
            nonlocal made, held
            pivot, dist = held[0][0], [r[1] for r in held]
            rows = sorted(held, key=lambda r: r[3][0])
            n_ids = np.array([len(r[3]) for r in rows], "<i4")
            row = [(part << 32) + made, pivot, min(dist), max(dist), b"".join(r[4] for r in rows), np.array([r[2] for r in rows], "<i8").tobytes(), np.concatenate([r[3] for r in rows]).astype("<i8").tobytes(), n_ids.tobytes()]
            made, held = made + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["block", "pivot", "lo", "hi", "x", "labels", "ids", "n_ids"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "dist", "label", "ids", "x")), strict=True):
                if held and (len(held) >= BLOCK or held[0][0] != row[0]):
                    yield close()
                held.append(row)
        if held:
            yield close()

    keyed = scratch.keep(classes.mapInArrow(assign, "pivot int, dist double, cls long, label long, ids array<long>, x binary"))
    parts = max(1, -(-keyed.count() // (4 * BLOCK)))
    ordered = keyed.repartitionByRange(parts, "pivot", "dist", "cls").sortWithinPartitions("pivot", "dist", "cls")
    out = scratch.keep(ordered.drop("cls").mapInArrow(cut, "block long, pivot int, lo double, hi double, x binary, labels binary, ids binary, n_ids binary"))
    scratch.drop(keyed)
    return out


def _planner(space, directory, first: int, last: int, shards: int):
    """The groups of queries that meet each annulus: those from ``first`` to ``last`` in the order of each query's bounds that
    can hold what the query looks for. A row without annulus (-1) tells that more may follow."""
    names = ["block", "shard", "q", "labels", "x", "least", "most"]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space_, (block, pivot, lo, hi) = space.value, directory.value
        for batch in batches:
            step = max(1, min(GROUP, (1 << 20) // max(1, len(block))))
            for at in range(0, batch.num_rows, step):
                some, out = batch.slice(at, step), []
                q, labels = some.column("q").to_numpy(), some.column("label").to_numpy()
                x = _matrix(some.column("v"), space_.d)
                least, most = (_targets(some.column(c)) for c in ("least", "most"))
                low, high = space_.score_bounds(x, pivot, lo, hi)
                # an annulus may serve a target if its scores reach the target's window: that doesn't change while best rows are found
                fits = np.zeros(low.shape, bool)
                wanted = np.zeros(low.shape, bool)
                floor = _targets(some.column("floor"))
                for t in range(most.shape[1]):
                    serves = low <= most[:, t, None]
                    fits |= serves & (high >= floor[:, t, None])
                    wanted |= serves & (high >= least[:, t, None])
                order = np.argsort(np.where(fits, -high, np.inf), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
                wanted &= fits
                now = wanted & (place >= first) & (place < last)
                if (wanted & (place >= last)).any():
                    out.append((-1, 0, b"", b"", b"", b"", b""))
                for b in np.flatnonzero(now.any(axis=0)):
                    who = np.flatnonzero(now[:, b])
                    out.append((int(block[b]), int(q[who[0]] % shards), q[who].tobytes(), labels[who].tobytes(), x[who].astype(space_.kind).tobytes(), least[who].tobytes(), most[who].tobytes()))
                if out:
                    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return plan, "block long, shard long, q binary, labels binary, x binary, least binary, most binary"


def _targets(column: pa.Array) -> np.ndarray:
    """The numbers of a query's targets as rows; every query of a search has as many."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _scanner(space, same: bool, k: int):
    """The k best rows of an annulus for each target of each query of a group: by score, then id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space_ = space.value
        for batch in batches:
            for r in batch.to_pylist():
                q, ql = np.frombuffer(r["q"], "<i8"), np.frombuffer(r["labels"], "<i8")
                least, most = (np.frombuffer(r[c], "<i8").reshape(len(q), -1) for c in ("least", "most"))
                ids, n_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["n_ids"], "<i4")
                begin = np.cumsum(n_ids) - n_ids
                scores = space_.unpack(r["x"]) @ space_.unpack(r["bx"]).T
                fit = (ql[:, None] == np.frombuffer(r["blabels"], "<i8")) == same
                for t in range(least.shape[1]):
                    ok = fit & (scores >= least[:, t, None]) & (scores <= most[:, t, None])
                    if ok.shape[1] > k:
                        worst = np.partition(np.where(ok, scores, -np.inf), -k, axis=1)[:, -k]
                        ok &= scores >= worst[:, None]
                    row, col = np.nonzero(ok)
                    # each class gives the rows of its ids; of all the k best count
                    times = n_ids[col]
                    of = np.repeat(np.arange(len(row)), times)
                    which = begin[col][of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                    row, score, found = row[of], scores[row, col][of], ids[which]
                    order = np.lexsort((found, -score, row))
                    row, score, found = row[order], score[order], found[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(q[row[keep]]), pa.array(np.full(keep.sum(), t, np.int32)), pa.array(score[keep].astype(np.int64)), pa.array(found[keep])], names=["q", "target", "score", "vec_id"])

    return scan, "q long, target int, score long, vec_id long"


def search(blocks: DataFrame, space: Space, queries: DataFrame, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """(q, target, rank, score, vec_id): the k best rows for each target of each query.

    ``queries``, a kept table, has q, label, v and for each target the least and the most score, arrays of equal length.
    """
    spark = blocks.sparkSession
    shared, place = spark.sparkContext.broadcast(space), F.row_number().over(Window.partitionBy("q", "target").orderBy(F.desc("score"), "vec_id"))
    n_blocks, n_queries = blocks.count(), queries.count()
    slices, shards = max(1, -(-n_blocks // DIRECTORY)), max(1, -(-n_queries // (GROUP * SHARED)))
    tasks = max(1, min(n_blocks * shards, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8))
    best = spark.createDataFrame([], "q long, target int, score long, vec_id long")
    content = blocks.select("block", F.col("x").alias("bx"), F.col("labels").alias("blabels"), "ids", "n_ids")
    content = content.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    for part in range(slices):
        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == part) if slices > 1 else blocks
        listed = mine.select("block", "pivot", "lo", "hi").orderBy("block").toArrow()
        directory = spark.sparkContext.broadcast([listed.column(c).to_numpy() for c in ("block", "pivot", "lo", "hi")])
        first, last = 0, FIRST
        while first < listed.num_rows:
            # the k-th best score so far is the least that can still count
            held = best.groupBy("q", "target").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") == k)
            held = held.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("target", "worst"))).alias("worst"))
            raised = F.transform("floor", lambda e, i: F.greatest(e, F.coalesce(F.element_at("worst", i), e)))
            asked = queries.withColumnRenamed("least", "floor").join(held, "q", "left")
            asked = asked.select("q", "label", "v", "floor", F.when(F.col("worst").isNull(), F.col("floor")).otherwise(raised).alias("least"), "most")
            plan, schema = _planner(shared, directory, first, last, shards)
            groups = scratch.keep(asked.mapInArrow(plan, schema))
            if groups.isEmpty():
                scratch.drop(groups)
                break
            met = groups.where("block >= 0").repartition(tasks, "block", "shard").join(content.repartition(tasks, "block", "shard"), ["block", "shard"])
            found = met.mapInArrow(*_scanner(shared, same, k))
            now = scratch.keep(best.union(found).withColumn("rank", place).where(F.col("rank") <= k).drop("rank"))
            scratch.drop(groups)
            scratch.drop(best)
            best, first, last = now, last, last * GROWTH
    return best.withColumn("rank", place)


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` marks anchors by vec_id. ``label``, over vec_id and label, takes the place of the label. A negative's score lies
    between ``low`` and ``high`` per cent of the positive's.
    """
    scratch = Scratch(table.sparkSession, "negatives")
    rows = quantised(table)
    rows = scratch.keep(rows.withColumn("label", label.cast("long")) if label is not None else rows)
    classes = scratch.keep(label_classes(rows, positives + 1))
    space = build_space(classes)
    anchors = rows.where(is_anchor).distinct().join(classes.select("cls", "label", "v"), ["label", "v"])
    anchors = scratch.keep(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("cls").alias("q")))
    if space is None or anchors.isEmpty():
        return anchors.select("anchor_id", F.lit(0).cast("long").alias("positive_id"), F.lit(0).alias("rank"), *(F.lit(0).cast("long").alias(c) for c in ("negative_id", "positive_score", "negative_score"))).where("false")
    blocks = build_blocks(classes, space, scratch)
    asked = classes.withColumnRenamed("cls", "q").join(anchors.select("q").distinct(), "q").select("q", "label", "v")
    window = [F.array(F.lit(x).cast("long")).alias(c) for x, c in ((_NONE, "least"), (_ALL, "most"))]
    # one more than asked for: the anchor itself may be among its class's best
    near = scratch.keep(search(blocks, space, scratch.keep(asked.select("*", *window)), True, positives + 1, scratch))
    # a target for each place of the list; places that share a score share the result
    places = F.transform(F.sequence(F.lit(1), F.lit(positives + 1)), lambda i: F.element_at("found", i))
    lists = near.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("found")).select("q", places.alias("scores"))
    # the same score again, none, or one below zero: a window without numbers
    fresh = lambda s, i: (s >= 0) & ((i == 0) | (F.get("scores", i - 1) != s))
    share = lambda s, part: s.cast("decimal(20,0)") * part / 100
    least = F.transform("scores", lambda s, i: F.when(fresh(s, i), F.ceil(share(s, low))).otherwise(_ALL).cast("long"))
    most = F.transform("scores", lambda s, i: F.when(fresh(s, i), F.floor(share(s, high))).otherwise(_NONE).cast("long"))
    windows = scratch.keep(asked.join(lists, "q").select("q", "label", "v", least.alias("least"), most.alias("most")))
    far = search(blocks, space, windows, False, negatives, scratch)
    # a score's result stands at the first place that has it
    scores = near.groupBy("q", F.col("score").alias("positive_score")).agg((F.min("rank") - 1).alias("target"))
    far = scratch.keep(far.join(scores, ["q", "target"]).select("q", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    place = F.row_number().over(Window.partitionBy("anchor_id", "q").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = anchors.join(near.select("q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "q")
    pairs = pairs.where("anchor_id != positive_id").withColumn("_place", place).where(F.col("_place") <= positives)
    return pairs.join(far, ["q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_sql() -> str:
    """The registered query in DuckDB's SQL."""
    return """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, r.label = a.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
        FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """
