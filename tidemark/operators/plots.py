"""Frames from which plots are drawn: kernel densities and their contours, scree, sorted k-distances, shares of clusters.

A density is summed where the points are: every task adds up one grid a group, so a group that holds most points is shared by all
tasks, and what is shuffled are grids, not points. One row for each group tells its range and bandwidth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import order
from tidemark.operators.lineage import cut

#: Points whose kernels are evaluated at once, and groups whose grids a task holds.
CHUNK, HELD = 256, 256

#: Steps between contour levels, up to a power of ten (fixed values).
STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)


def bandwidths(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """One row for each group of three points or more with spread in both directions: its range, the inverse (a, b; b, c) of the
    kernel's covariance, which is the points' times n^(-1/3), its deviations hx and hy, and ``norm``, by which sums are divided."""
    m = points.groupBy(group).agg(
        F.count(F.lit(1)).alias("k"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
        F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy"),
    )
    shrink = F.pow(F.col("k").cast("double"), F.lit(-1 / 3))
    m = m.where("k >= 3").withColumns({c: F.col(c) * shrink for c in ("vx", "vy", "vxy")})
    m = m.withColumn("det", F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")).where("det > 1e-12 * vx * vy")
    return m.select(
        group, "x0", "x1", "y0", "y1", (F.col("vy") / F.col("det")).alias("a"), (-F.col("vxy") / F.col("det")).alias("b"), (F.col("vx") / F.col("det")).alias("c"),
        F.sqrt("vx").alias("hx"), F.sqrt("vy").alias("hy"), (F.col("k") * 2 * math.pi * F.sqrt("det")).alias("norm"),
    )


def density(points: DataFrame, x: str, y: str, group: str | None = None, n: int = 50, per_bandwidth: int | None = None) -> DataFrame:
    """(group, i, j, gx, gy, density): a Gaussian kernel estimate for each group over n by n nodes of its own range.

    Rows with a missing or non-finite coordinate take no part; a null group is a group. With ``per_bandwidth`` points move to the
    nearest node of a lattice with so many steps a deviation of the kernel and are counted there, so that the work stops growing
    with the points; without it every point's kernel is evaluated where it is.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    own = F.col(group) if group else F.lit(None).cast("string")
    p = points.select(own.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite("x") & finite("y"))
    each = cut(bandwidths(p, "g", "x", "y").withColumn("id", F.monotonically_increasing_id()))
    # Spark broadcasts the groups when it finds them small and else splits a group that holds many points
    near = p.join(each.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    parts, kernel = ["id", "x0", "x1", "y0", "y1", "a", "b", "c"], ["px", "py"]
    if per_bandwidth:
        node = lambda v, o, h: F.col(o) + F.round((F.col(v) - F.col(o)) / F.col(h) * per_bandwidth) * F.col(h) / per_bandwidth
        near = near.select(*parts, node("x", "x0", "hx").alias("px"), node("y", "y0", "hy").alias("py")).groupBy(*parts, *kernel).agg(F.count(F.lit(1)).cast("double").alias("w"))
    else:
        near = near.select(*parts, F.col("x").alias("px"), F.col("y").alias("py"), F.lit(1.0).alias("w"))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        at = [v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n), indexing="ij")]

        def out() -> pd.DataFrame:
            ids = np.repeat(np.fromiter(held, np.int64, len(held)), n * n)
            return pd.DataFrame({"id": ids, "i": np.tile(at[0], len(held)), "j": np.tile(at[1], len(held)), "s": np.concatenate([v.ravel() for v in held.values()])})

        for f in frames:
            for key, rows in f.groupby("id"):
                r = rows.iloc[0]
                gx, gy = np.linspace(r["x0"], r["x1"], n), np.linspace(r["y0"], r["y1"], n)
                total = held.setdefault(int(key), np.zeros((n, n)))
                px, py, w = (rows[c].to_numpy() for c in ("px", "py", "w"))
                for s in range(0, len(rows), CHUNK):
                    dx, dy = gx - px[s : s + CHUNK, None], gy - py[s : s + CHUNK, None]
                    q = (r["a"] * dx * dx)[:, :, None] + (2 * r["b"] * dx)[:, :, None] * dy[:, None, :] + (r["c"] * dy * dy)[:, None, :]
                    total += np.tensordot(w[s : s + CHUNK], np.exp(-0.5 * q), 1)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    got = near.mapInPandas(sums, "id long, i int, j int, s double").groupBy("id", "i", "j").agg(F.sum("s").alias("s")).join(each, "id")
    place = lambda k, lo, hi: F.col(lo) + F.col(k) * (F.col(hi) - F.col(lo)) / (n - 1)
    got = got.select("g", "i", "j", place("i", "x0", "x1").alias("gx"), place("j", "y0", "y1").alias("gy"), (F.col("s") / F.col("norm")).alias("density"))
    return got.withColumnRenamed("g", group) if group else got.drop("g")


def levels(nodes: DataFrame, group: str, intervals: int = 8) -> DataFrame:
    """(group, level): the multiples of a round step strictly between a group's least and largest density, at most about ``intervals``
    of them. A group whose densities are all alike has none."""
    m = nodes.groupBy(group).agg(F.min("density").alias("lo"), F.max("density").alias("hi")).where("hi > lo")
    raw = (F.col("hi") - F.col("lo")) / intervals
    m = m.withColumn("raw", raw).withColumn("mag", F.pow(F.lit(10.0), F.floor(F.log10("raw"))))
    step = F.col("mag") * F.element_at(F.filter(F.array(*[F.lit(v) for v in STEPS]), lambda v: v >= F.col("raw") / F.col("mag") - 1e-9), 1)
    m = m.withColumn("step", step).withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / F.col("step")), F.ceil(F.col("hi") / F.col("step")))))
    return m.select(group, "lo", "hi", (F.col("k") * F.col("step")).alias("level")).where("level > lo and level < hi").select(group, "level")


def contours(nodes: DataFrame, group: str, intervals: int = 8) -> DataFrame:
    """(group, level, i, j, piece, x1, y1, x2, y2): the straight pieces of every contour line, by marching squares.

    ``nodes`` are rows of ``density``. In each cell of four nodes, a side is crossed where one end reaches the level and the other
    doesn't, at the place between them by proportion. Two crossings are one piece; four are two, whose ends are paired so that the
    diagonal which the cell's mean sides with stays together. Pieces of neighbouring cells meet in the same points.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (0, 1) for dj in (0, 1)])).alias("c")
    cells = nodes.select(group, "i", "j", "gx", "gy", "density", corner)
    pick = lambda di, dj: F.max(F.when((F.col("c.di") == di) & (F.col("c.dj") == dj), F.col("density")))
    cells = cells.groupBy(group, (F.col("i") - F.col("c.di")).alias("i"), (F.col("j") - F.col("c.dj")).alias("j")).agg(
        *[pick(di, dj).alias(f"v{di}{dj}") for di in (0, 1) for dj in (0, 1)], F.count(F.lit(1)).alias("n"),
        F.min("gx").alias("lx"), F.max("gx").alias("hx"), F.min("gy").alias("ly"), F.max("gy").alias("hy"),
    ).where("n = 4")
    asked = levels(nodes, group, intervals).withColumnRenamed(group, "_g")
    between = (F.col("level") > F.least("v00", "v10", "v01", "v11")) & (F.col("level") <= F.greatest("v00", "v10", "v01", "v11"))
    met = cells.join(asked, F.col(group).eqNullSafe(F.col("_g")) & between).drop("_g")

    def side(a: str, b: str, x: Column | None, y: Column | None) -> Column:
        t = (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))
        px = x if x is not None else F.col("lx") + t * (F.col("hx") - F.col("lx"))
        py = y if y is not None else F.col("ly") + t * (F.col("hy") - F.col("ly"))
        return F.when((F.col(a) >= F.col("level")) != (F.col(b) >= F.col("level")), F.struct(px.alias("x"), py.alias("y")))

    met = met.withColumns({"low": side("v00", "v10", None, F.col("ly")), "right": side("v10", "v11", F.col("hx"), None), "top": side("v01", "v11", None, F.col("hy")), "left": side("v00", "v01", F.col("lx"), None)})
    met = met.withColumn("ends", F.array_compact(F.array("low", "right", "top", "left")))
    pair = lambda a, b: F.struct(a.alias("p"), b.alias("q"))
    mean = (F.col("v00") + F.col("v10") + F.col("v01") + F.col("v11")) / 4
    together = (mean >= F.col("level")) == (F.col("v00") >= F.col("level"))
    pieces = (
        F.when((F.size("ends") == 4) & together, F.array(pair(F.col("low"), F.col("right")), pair(F.col("top"), F.col("left"))))
        .when(F.size("ends") == 4, F.array(pair(F.col("low"), F.col("left")), pair(F.col("right"), F.col("top"))))
        .otherwise(F.array(pair(F.get("ends", F.lit(0)), F.get("ends", F.lit(1)))))
    )
    out = met.select(group, "level", "i", "j", F.posexplode(pieces).alias("piece", "s"))
    return out.select(group, "level", "i", "j", "piece", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def scree(spark, share: np.ndarray) -> DataFrame:
    """(component, share, cumulative) of the shares of variance that ``ml.pca`` gives, one row for each component."""
    rows = [(k + 1, float(s), float(c)) for k, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True))]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")


def k_distances(neighbours: DataFrame, k: int, key: str = "key") -> DataFrame:
    """(place, key, distance): distances to the k-th neighbour in ascending order, places from 0; the elbow is read off this curve."""
    far = neighbours.where(F.col("k") == k).select(key, "distance")
    return order.numbered(far, ["distance", key]).select("place", key, "distance")


def shares(df: DataFrame, whole: str, part: str) -> DataFrame:
    """(whole, part, n, share): rows of each part within each whole and their share of it, as pies and stacked bars show them."""
    n = df.groupBy(whole, part).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(F.col(whole).alias("_w")).agg(F.sum("n").alias("_t"))
    return n.join(total, F.col(whole).eqNullSafe(F.col("_w"))).select(whole, part, "n", (F.col("n") / F.col("_t")).alias("share"))
