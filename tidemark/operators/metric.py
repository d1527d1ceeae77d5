"""Metric joins: points that are near each other, without all pairs of points.

Every point belongs to its nearest pivot. The points of a pivot are sorted by their distance to it and cut into slices, and a slice
knows the least and the largest distance of its points to every pivot. A query with a radius is copied to those slices that its ball may
reach: by the triangle inequality none of a slice's points is nearer than the query's distance to a pivot differs from theirs, and a
point of another pivot is no nearer than half of what the query's distance to that pivot exceeds the one to its own. Queries meet a
slice in groups. Neighbouring slices make a shelf: a group travels once to each shelf, with a bit for each query and slice, and what is
shuffled doesn't grow with the number of slices. Products of matrices rule out pairs beyond the radius; all others are measured by differences.

How much this spares depends on the points: in few dimensions, or in clusters, almost all; where all distances are alike, as
between random points of many dimensions, nothing, and every query meets every slice.

Keys are longs and unique. Points with a null key or vector, or one with a null or non-finite component, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: Most points of a slice, queries of a group, pivots, points they are chosen from, and slices whose bounds are broadcast at once.
SLICE, GROUP, PIVOTS, SAMPLE, DIRECTORY = 512, 256, 32, 4096, 1 << 15
#: Groups of queries that share one copy of a slice.
SHARED = 512
#: Most slices of a shelf; up to there a table has some SHELVES of them.
SHELF = SHELVES = 32


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, by differences and not by products: equal points are exactly 0 apart."""
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), 64):
        gap = x[i : i + 64, None, :] - y[None]
        out[i : i + 64] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def near_distances(x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``distances`` where they are at most the row's radius, or little more; infinite elsewhere."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        square = x @ y.T
        square *= -2
        square += a[:, None]
        square += b[None]
        room = 1e-14 * (x.shape[1] + 8) * (a + b.max(initial=0))
        maybe = ~(square > (radius * radius * (1 + 1e-12) + room)[:, None])  # what isn't a number is measured
    i, j = np.nonzero(maybe)
    if 4 * len(i) > maybe.size:
        return distances(x, y)
    out = np.full(maybe.shape, np.inf)
    for s in range(0, len(i), 1 << 14):
        gap = (x[i[s : s + (1 << 14)]] - y[j[s : s + (1 << 14)]])[:, None, :]
        out[i[s : s + (1 << 14)], j[s : s + (1 << 14)]] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))[:, 0]
    return out


def usable(points: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """(key long, v array<double>, w long) of the points that take part; a weight is 1 unless its column is named."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    w = F.col(weight) if weight else F.lit(1)
    return points.select(F.col(key).cast("long").alias("key"), v.alias("v"), w.cast("long").alias("w")).where(F.col("key").isNotNull() & F.col("v").isNotNull()).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Slices:
    """The points of a metric join, stored in slices."""

    def __init__(self, points: DataFrame, key: str, vector: str, weight: str | None = None):
        rows = usable(points, key, vector, weight)
        self.spark = spark = points.sparkSession
        got = rows.select("v").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow().column(0).combine_chunks()
        self.n = rows.count()
        sample = _matrix(got) if len(got) else np.zeros((0, 1))
        self.shelf = max(1, min(SHELF, self.n // (SLICE * SHELVES)))
        self.pivots = spark.sparkContext.broadcast(self._pivots(sample, max(1, min(PIVOTS, self.n // 64))))
        self.table = cut(self._cut(rows))
        self.count = self.table.count()

    @staticmethod
    def _pivots(x: np.ndarray, k: int) -> np.ndarray:
        """Points of the sample that lie farthest from those before."""
        if not len(x):
            return x
        pick = [0]
        away = distances(x, x[:1])[:, 0]
        while len(pick) < k and away.max() > 0:
            pick.append(int(away.argmax()))
            away = np.minimum(away, distances(x, x[pick[-1:]])[:, 0])
        return x[pick]

    def _cut(self, rows: DataFrame) -> DataFrame:
        pivots, shelf = self.pivots, self.shelf

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = distances(_matrix(batch.column("v")), pivots.value)
                own = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.int32()), pa.array(away[np.arange(len(own)), own]), batch.column("v"), batch.column("w")], names=["key", "cell", "dist", "v", "w"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, made, held = TaskContext.get().partitionId(), 0, []
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.float64()), pa.list_(pa.float64())]

            def close() -> pa.RecordBatch:
                nonlocal made, held
                x = np.stack([v for *_, v in held])
                keys, weights = (np.array([r[i] for r in held], "<i8").tobytes() for i in (0, 2))
                away = distances(x, pivots.value)
                row = [(part << 32) + made, (part << 32) + made // shelf, held[0][1], len(held), keys, weights, x.tobytes(), away.min(axis=0), away.max(axis=0)]
                made, held = made + 1, []
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["slice", "shelf", "cell", "n", "keys", "weights", "x", "lo", "hi"])

            for batch in batches:
                x = _matrix(batch.column("v"))
                for key, cell, w, v in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "w")), x, strict=True):
                    if held and (len(held) >= SLICE or held[0][1] != cell):
                        yield close()
                    held.append((key, cell, w, v))
            if held:
                yield close()

        dealt = rows.mapInArrow(assign, "key long, cell int, dist double, v array<double>, w long").repartitionByRange(max(1, -(-self.n // (max(16, shelf) * SLICE))), "cell", "dist", "key")
        return dealt.sortWithinPartitions("cell", "dist", "key").mapInArrow(pack, "slice long, shelf long, cell int, n int, keys binary, weights binary, x binary, lo array<double>, hi array<double>")

    def groups(self, queries: DataFrame) -> Iterator[DataFrame]:
        """Which queries (key, v, radius) meet which slices: (shelf, shard, keys, x, radius, near, pairs), a frame for each part of the
        directory. ``near`` has a bit for each query and slice of the shelf, ``pairs`` is how many pairs of points that makes."""
        parts, shards = max(1, -(-self.count // DIRECTORY)), self._shards(queries)
        pivots = self.pivots
        for part in range(parts):
            mine = self.table.where(F.pmod(F.xxhash64("shelf"), F.lit(parts)) == part) if parts > 1 else self.table
            listed = mine.select("slice", "shelf", "cell", "n", "lo", "hi").orderBy("slice").toArrow().combine_chunks()
            if not len(listed):
                continue
            columns = {c: listed.column(c).combine_chunks() for c in listed.column_names}
            bounds = self.spark.sparkContext.broadcast((*(columns[c].to_numpy() for c in ("shelf", "cell", "n")), _matrix(columns["lo"]), _matrix(columns["hi"])))

            def reach(batches: Iterator[pa.RecordBatch], bounds=bounds) -> Iterator[pa.RecordBatch]:
                names, cell, n, lo, hi = bounds.value
                starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
                for batch in batches:
                    step = max(1, min(GROUP, (1 << 21) // max(1, lo.size)))
                    for at in range(0, batch.num_rows, step):
                        some, out = batch.slice(at, step), []
                        keys, x, radius = some.column("key").to_numpy(), _matrix(some.column("v")), some.column("radius").to_numpy()
                        away = distances(x, pivots.value)
                        room = 1e-9 * (1 + away.max(axis=1, initial=0))
                        gap = np.maximum(lo[None] - away[:, None], away[:, None] - hi[None]).max(axis=2)
                        gap = np.maximum(gap, (away[:, cell] - away.min(axis=1)[:, None]) / 2)
                        near = gap <= (radius + room)[:, None]
                        for first, last in zip(starts, [*starts[1:], len(names)], strict=True):
                            here = near[:, first:last]
                            who = np.flatnonzero(here.any(axis=1))
                            if len(who):
                                out.append((int(names[first]), int(keys[who[0]] % shards), keys[who].tobytes(), x[who].tobytes(), radius[who].tobytes(), np.packbits(here[who]).tobytes(), int((here[who].sum(axis=0) * n[first:last]).sum())))
                        if out:
                            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64()]
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shelf", "shard", "keys", "x", "radius", "near", "pairs"])

            yield queries.select("key", "v", F.col("radius").cast("double").alias("radius")).mapInArrow(reach, "shelf long, shard long, keys binary, x binary, radius binary, near binary, pairs long")

    def _shards(self, queries: DataFrame) -> int:
        return max(1, -(-queries.count() // (GROUP * SHARED)))

    def meet(self, queries: DataFrame, found: Callable, schema: str, merge: Callable | None = None) -> DataFrame:
        """What ``found(keys, radius, slice keys, slice weights, distances)`` returns, arrays by column, for each group of queries and slice;
        distances beyond the radius are infinite. ``merge`` makes one result of those of a group and a shelf."""
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, slices = None, []
            for batch in batches:
                for r in batch.to_pylist():
                    if (r["shelf"], r["shard"]) != at:
                        at, slices = (r["shelf"], r["shard"]), []
                    keys = np.frombuffer(r["keys"], "<i8")
                    x = np.frombuffer(r["x"]).reshape(len(keys), -1)
                    if r["slice"] is not None:  # the slices of a shelf come first, in their order
                        slices.append((keys, np.frombuffer(r["weights"], "<i8"), x))
                        continue
                    radius, got = np.frombuffer(r["radius"]), []
                    near = np.unpackbits(np.frombuffer(r["near"], np.uint8), count=len(keys) * len(slices)).reshape(len(keys), -1).astype(bool)
                    for s in np.flatnonzero(near.any(axis=0)):
                        (other, weights, y), who = slices[s], np.flatnonzero(near[:, s])
                        got.append(found(keys[who], radius[who], other, weights, near_distances(x[who], y, radius[who])))
                    for part in [merge(*map(np.concatenate, zip(*got, strict=True)))] if merge and got else got:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=names)

        shards = self._shards(queries)
        none = F.lit(None)
        content = self.table.select("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "slice", "keys", "x", "weights", none.cast("binary").alias("radius"), none.cast("binary").alias("near"))
        tasks = max(1, min(self.count * shards, 8 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        out = None
        for groups in self.groups(queries):
            asked = groups.select("shelf", "shard", none.cast("long").alias("slice"), "keys", "x", none.cast("binary").alias("weights"), "radius", "near")
            dealt = content.union(asked).repartition(tasks, "shelf", "shard").sortWithinPartitions("shelf", "shard", F.asc_nulls_last("slice"))
            met = dealt.mapInArrow(run, schema)
            out = met if out is None else out.union(met)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def pairs_met(self, queries: DataFrame) -> int:
        """How many pairs of a query (key, v, radius) and a point are looked at."""
        return sum(g.agg(F.sum("pairs")).first()[0] or 0 for g in self.groups(queries))

    def nearest_in_slice(self, k: int) -> DataFrame:
        """(key, v, radius) of every point: the distance to its k-th nearest, itself included, in its own slice or those of its shelf. Infinite
        where they have fewer points."""
        d = self.pivots.value.shape[1]

        def look(table: pa.Table) -> pa.Table:
            parts = [(np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["x"]).reshape(-1, d)) for r in table.to_pylist()]
            found = []
            for a, (_, x) in enumerate(parts):
                best = np.full((len(x), k), np.inf)
                for b in [a, *(b for b in range(len(parts)) if b != a)]:
                    y = parts[b][1]
                    best = np.partition(np.c_[best, near_distances(x, y, best.max(axis=1))], k - 1, axis=1)[:, :k]
                found.append(best.max(axis=1) * (1 + 1e-12))
            rows = [v for _, x in parts for v in x]
            return pa.table({"key": np.concatenate([p[0] for p in parts]), "v": pa.array(rows, pa.list_(pa.float64())), "radius": np.concatenate(found)})

        return self.table.select("shelf", "keys", "x").repartition(max(1, self.count // self.shelf), "shelf").groupBy("shelf").applyInArrow(look, "key long, v array<double>, radius double")


def nearest(points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, place, other, distance) to the k nearest points, itself among them; ties by key. Exact: no point's k-th nearest is
    farther than in its own slice, so slices beyond that distance aren't met."""
    slices = Slices(points, key, vector)

    def best(keys, radius, other, weights, dist):
        i, j = np.nonzero(dist <= radius[:, None])
        return first(keys[i], other[j], dist[i, j])

    def first(key, other, dist):
        order = np.lexsort((other, dist, key))
        key, other, dist = key[order], other[order], dist[order]
        keep = np.arange(len(key)) - np.searchsorted(key, key) < k
        return key[keep], other[keep], dist[keep]

    asked = cut(slices.nearest_in_slice(k))
    found = slices.meet(asked, best, "key long, other long, distance double", first)
    place = F.row_number().over(Window.partitionBy("key").orderBy("distance", "other")) - 1
    return found.withColumn("place", place).where(F.col("place") < k).select("key", "place", "other", "distance")


def within(points: DataFrame, key: str, vector: str, radius: float) -> DataFrame:
    """(a, b, distance) of all ordered pairs at most ``radius`` apart, each point with itself among them."""
    slices = Slices(points, key, vector)

    def close(keys, radius, other, weights, dist):
        i, j = np.nonzero(dist <= radius[:, None])
        return keys[i], other[j], dist[i, j]

    return slices.meet(usable(points, key, vector).withColumn("radius", F.lit(float(radius))), close, "a long, b long, distance double")
