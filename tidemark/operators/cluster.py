"""Clusters of points: neighbours, density clusters, validity indices and agreement of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import native
from tidemark.operators import metric, order
from tidemark.operators.graph import components, spanning
from tidemark.operators.lineage import cut

#: Rows of a block when every point meets every other.
BLOCK = 4096
#: Label of points that belong to no cluster.
NOISE = -1


def top_k(df: DataFrame, keys: list[str], by: Column, k: int, tie: str) -> DataFrame:
    """The k rows with the largest ``by`` of each group; ties by the column ``tie``."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def components_long(points: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, j, x) for each component of each vector."""
    return points.select(key, label, F.posexplode(F.col(vector).cast("array<double>")).alias("j", "x"))


def without_noise(points: DataFrame, label: str) -> DataFrame:
    """Points of clusters; rows without a label stay out as well."""
    return points.where(F.col(label) != NOISE)


def with_clusters(features: DataFrame, clusters: DataFrame, how: str = "inner", noise: bool = False) -> DataFrame:
    """Features with their fly's cluster, joined by fly_id; noise is left out unless asked for.

    ``clusters`` has ``cluster``, or else ``cluster_hdbscan``. With a left join flies without a cluster stay, unlabelled.
    """
    name = "cluster" if "cluster" in clusters.columns else "cluster_hdbscan"
    found = clusters.select("fly_id", F.col(name).cast("int").alias("cluster")).dropDuplicates(["fly_id"])
    return features.join(found if noise else without_noise(found, "cluster"), "fly_id", how)


def centroid_scores(long: DataFrame, label: str = "label") -> DataFrame:
    """n_clusters, davies_bouldin, calinski_harabasz from centroids, without distances between points and without noise.
    Fewer than two clusters: null."""
    key, long = long.columns[0], without_noise(long, label)
    cent = long.groupBy(label, "j").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"))
    off = long.join(cent.select(label, "j", "c"), [label, "j"])
    each = off.groupBy(key, label).agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("sq"))
    inner = each.groupBy(label).agg(F.avg(F.sqrt("sq")).alias("s"), F.sum("sq").alias("ssw"), F.count(F.lit(1)).alias("n"))
    grand = cent.groupBy("j").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("g"))
    between = cent.join(grand, "j").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) ** 2).alias("ssb"))
    other = cent.select(F.col(label).alias("l2"), "j", F.col("c").alias("c2"))
    gaps = cent.join(other, "j").where(F.col(label) != F.col("l2")).groupBy(label, "l2").agg(F.sqrt(F.sum((F.col("c") - F.col("c2")) ** 2)).alias("m"))
    s2 = inner.select(F.col(label).alias("l2"), F.col("s").alias("s2"))
    worst = gaps.join(inner, label).join(s2, "l2").groupBy(label).agg(F.max(F.try_divide(F.col("s") + F.col("s2"), F.col("m"))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    whole = inner.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("ssw").alias("ssw"))
    ch = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    return whole.join(F.broadcast(between)).join(F.broadcast(db)).select(F.col("k").alias("n_clusters"), F.when(F.col("k") >= 2, F.col("davies_bouldin")).alias("davies_bouldin"), F.when(F.col("k") >= 2, ch).alias("calinski_harabasz"))


def _blocks(points: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """Points packed into binary blocks, so that all pairs of blocks are few rows."""
    n = points.count()
    names = [key, vector] + ([label] if label else [])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            f = pd.concat(got, ignore_index=True)
            for i in range(0, len(f), BLOCK):
                p = f.iloc[i : i + BLOCK]
                x = np.stack([np.asarray(v, float) for v in p[vector]])
                yield pd.DataFrame([{"ids": p[key].to_numpy("<i8").tobytes(), "labels": p[label].to_numpy("<i8").tobytes() if label else b"", "x": x.tobytes(), "d": x.shape[1]}])

    return points.select(*names).where(F.col(vector).isNotNull()).repartition(max(1, -(-n // BLOCK))).mapInPandas(pack, "ids binary, labels binary, x binary, d int")


def _open(r, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(getattr(r, f"x{side}")).reshape(-1, r.d)
    return np.frombuffer(getattr(r, f"ids{side}"), "<i8"), np.frombuffer(getattr(r, f"labels{side}"), "<i8"), x


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of matrices where points are well apart, differences where they are near: equal points are exactly 0 apart."""
    out, centre = np.empty((len(x), len(y))), y.mean(axis=0) if len(y) else 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        y0 = y - centre
        b = np.einsum("ij,ij->i", y0, y0)
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            x0 = part - centre
            a = np.einsum("ij,ij->i", x0, x0)
            both = a[:, None] + b
            square = both - 2 * (x0 @ y0.T)
            i, j = np.nonzero(~(square > 1e-3 * both))
            if 4 * len(i) > square.size:
                out[s : s + 256] = metric.distances(part, y)
                continue
            out[s : s + 256] = np.sqrt(np.maximum(square, 0))
            gap = part[i] - y[j]
            out[s + i, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _pairs(blocks: DataFrame, many: int = 16) -> DataFrame:
    """All pairs of blocks; a task's block meets some ``many`` others."""
    blocks = cut(blocks)
    other = blocks.select(*[F.col(c).alias(f"{c}_b") for c in ("ids", "labels", "x")])
    return blocks.crossJoin(other.coalesce(max(1, -(-other.rdd.getNumPartitions() // many))))


def knn(points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, k, distance) to the k nearest points, itself among them (k = 0 first) at distance 0; ties by key."""
    return metric.nearest(points, key, vector, k).select(F.col("key").alias(key), F.col("place").cast("int").alias("k"), "distance")


def silhouette(points: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Mean Euclidean silhouette without noise; a point alone in its cluster counts 0. One row for each point, cluster and task
    in between."""
    points = without_noise(points, label)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, dict] = {}  # of each block of the task, over all that it meets
        for f in frames:
            for r in f.itertuples(index=False):
                (a, la, x), (b, lb, y) = _open(r), _open(r, "_b")
                names, at = np.unique(lb, return_inverse=True)
                total = _distances(x, y) @ np.eye(len(names))[at]
                alike = np.intersect1d(a, b).size
                _, _, of = held.setdefault(r.ids, (a, la, {}))
                for k, c in enumerate(names.tolist()):
                    m = lb == c
                    n = m.sum() - ((a[:, None] == b[m][None]).sum(1) if alike else np.zeros(len(a), np.int64))
                    before = of.get(c, (0, 0))
                    of[c] = before[0] + total[:, k], before[1] + n
        for a, la, of in held.values():
            for c, (s, n) in of.items():
                yield pd.DataFrame({key: a, "own": la, "cluster": c, "s": s, "n": n})

    got = _pairs(_blocks(points, key, vector, label)).mapInPandas(sums, f"{key} long, own long, cluster long, s double, n long")
    each = got.groupBy(key, "own", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("m", F.try_divide("s", "n"))
    one = each.groupBy(key).agg(F.max(F.when(F.col("own") == F.col("cluster"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster"), F.col("m"))).alias("b"))
    return one.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """ari, ami and nmi (both by arithmetic mean) of two labellings, from their contingency counts.

    The information expected by chance is summed over pairs of margins, of which there are as many as pairs of labels.
    """
    c = df.groupBy(left, right).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w1, w2 = Window.partitionBy(left), Window.partitionBy(right)
    cells = c.withColumn("a", F.sum("n").over(w1)).withColumn("b", F.sum("n").over(w2))
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    tot = c.agg(F.sum("n").alias("t"))
    rows, cols = c.groupBy(left).agg(F.sum("n").alias("a")), c.groupBy(right).agg(F.sum("n").alias("b"))
    ent = lambda x: -F.sum(F.col(x) / F.col("t") * F.ln(F.col(x) / F.col("t")))
    one = cells.join(F.broadcast(tot)).agg(F.sum(two("n")).alias("ij"), F.max("t").alias("t"), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    ra = rows.join(F.broadcast(tot)).agg(F.sum(two("a")).alias("ai"), ent("a").alias("ha"))
    rb = cols.join(F.broadcast(tot)).agg(F.sum(two("b")).alias("bj"), ent("b").alias("hb"))
    j = one.join(F.broadcast(ra)).join(F.broadcast(rb)).withColumn("e", F.col("ai") * F.col("bj") / (F.col("t") * (F.col("t") - 1) / 2))
    margins = rows.select("a", F.lit(0).alias("_j")).join(cols.select("b", F.lit(0).alias("_j")), "_j").join(F.broadcast(tot))
    chance = margins.agg(F.coalesce(F.sum(native.expected_information(F.col("a"), F.col("b"), F.col("t"))), F.lit(0.0)).alias("emi"))
    j = j.join(F.broadcast(chance)).withColumn("h", (F.col("ha") + F.col("hb")) / 2)
    ami = F.when(F.abs(F.col("h") - F.col("emi")) < 1e-12, 1.0).otherwise((F.col("mi") - F.col("emi")) / (F.col("h") - F.col("emi")))
    return j.select(ami.alias("ami"), F.try_divide(F.col("ij") - F.col("e"), (F.col("ai") + F.col("bj")) / 2 - F.col("e")).alias("ari"), F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2).alias("nmi"))


def elbow(distances: DataFrame, distance: str) -> DataFrame:
    """(index, distance): where the second difference of the sorted distances is largest, first on ties; fewer than three give no row."""
    d = order.numbered(distances.select(F.col(distance).alias("d")).where("d is not null"), ["d"], "i")
    d = order.with_next(d, "d", "i", 2).withColumn("bend", F.col("next2") - 2 * F.col("next1") + F.col("d")).where("bend is not null")
    best = d.agg(F.max(F.struct("bend", -F.col("i"), "d")).alias("m")).where("m is not null")
    return best.select((-F.col("m.col2")).cast("int").alias("index"), F.col("m.d").alias("distance"))


def dbscan(points: DataFrame, key: str, vector: str, eps: float, min_samples: int, most_rounds: int = 50) -> DataFrame:
    """(key, cluster): density clusters numbered by their smallest core key; -1 for noise. The point itself counts.

    Equal points are one point that counts as often. Neighbours are counted by a metric join. Core points then meet the core
    points near them, and each meeting of a group with a slice gives its smallest links, one for each point, not its pairs; their
    components are the clusters. Other points have fewer than ``min_samples`` neighbours; they go to the cluster with the
    smallest number among theirs.
    """
    rows = metric.usable(points, key, vector)
    one = cut(rows.groupBy("v").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("w")))
    asked = one.withColumn("radius", F.lit(float(eps)))

    def count(keys, radius, other, weights, dist):
        return keys, (dist <= radius[:, None]) @ weights

    def added(keys, n):
        names, at = np.unique(keys, return_inverse=True)
        return names, np.bincount(at, n, len(names)).astype(np.int64)

    def links(keys, radius, other, weights, dist):
        near, most = dist <= radius[:, None], np.iinfo(np.int64).max
        a, b = keys.copy(), other.copy()
        while True:  # the smallest key that a point reaches within this meeting
            least = np.minimum(b, np.where(near, a[:, None], most).min(axis=0))
            new = np.minimum(a, np.where(near, least, most).min(axis=1))
            if np.array_equal(new, a) and np.array_equal(least, b):
                break
            a, b = new, least
        met = near.any(axis=0)
        return np.r_[keys, other[met]], np.r_[a, b[met]]

    def around(keys, radius, other, weights, dist):
        i, j = np.nonzero(dist <= radius[:, None])
        return keys[i], other[j]

    near = metric.Slices(one, "key", "v", "w").meet(asked, count, "key long, n long", added).groupBy("key").agg(F.sum("n").alias("n"))
    core = cut(near.where(F.col("n") >= min_samples).select("key"))
    dense = metric.Slices(one.join(core, "key"), "key", "v")
    label = cut(components(cut(spanning(dense.meet(asked.join(core, "key"), links, "a long, b long"))), most_rounds))
    named = cut(label.join(order.numbered(label.select("label").distinct(), ["label"], "cluster"), "label").select("node", "cluster"))
    beside = dense.meet(asked.join(core, "key", "left_anti"), around, "key long, node long").join(named, "node").groupBy("key").agg(F.min("cluster").alias("cluster"))
    found = one.select("key", "v").join(named.select(F.col("node").alias("key"), "cluster").union(beside), "key")
    each = rows.select(F.col("key").alias("_k"), "v").join(found.select("v", "cluster"), "v").select("_k", "cluster")
    return points.select(key).join(each, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))
