"""Queries of the small operators: filters, reshapes, counts, orders; and the same in DuckDB's SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.operators import cluster, features, health, ml, order, plots, sliding, stats
from tidemark.operators.lineage import cut
from tidemark.plans import core, statistics
from tidemark.plans.core import DENSE, FLY_SQL, GOOD, HOURLY, TIME_SQL, _kept, rounded
from tidemark.schemas import FLY, READING_TYPES
from tidemark.sources import adapter, store

E = f"e AS (SELECT event_id, {FLY_SQL}, ts, value, {TIME_SQL.replace('datetime', 'ts')}, CASE event_type WHEN 'view' THEN 'MT' WHEN 'click' THEN 'CT' ELSE 'Pn' END AS reading_type FROM events)"
HEAT = ["mesor_mean", "amplitude_mean", "total_sleep_mean", "waso_mean"]


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _points(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet")


def _plane(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select("label", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


def _scree(s: SparkSession, d: str) -> DataFrame:
    return rounded(plots.scree(s, ml.pca(_points(s, d), "embedding")[2]))


#: The kernel estimate over 50 by 50 nodes for each group, and its contour pieces, in DuckDB's SQL.
DENSITY = """p AS (SELECT {group} AS g, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    m AS (SELECT g, count(*) AS k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_samp(x) * pow(count(*), -1.0 / 3) AS vx,
          var_samp(y) * pow(count(*), -1.0 / 3) AS vy, covar_samp(x, y) * pow(count(*), -1.0 / 3) AS vxy FROM p GROUP BY g HAVING count(*) >= 3),
    w AS (SELECT *, vx * vy - vxy * vxy AS det FROM m WHERE vx * vy - vxy * vxy > 1e-12 * vx * vy),
    spots AS (SELECT w.*, i, j, x0 + i * (x1 - x0) / 49 AS gx, y0 + j * (y1 - y0) / 49 AS gy FROM w, range(50) a(i), range(50) b(j)),
    nodes AS (SELECT spots.g, i, j, any_value(gx) AS gx, any_value(gy) AS gy,
              sum(exp(-0.5 * (vy * (gx - x) * (gx - x) - 2 * vxy * (gx - x) * (gy - y) + vx * (gy - y) * (gy - y)) / det)) / any_value(k * 2 * pi() * sqrt(det)) AS density
              FROM spots JOIN p ON spots.g IS NOT DISTINCT FROM p.g GROUP BY spots.g, i, j)"""
CONTOURS = f"""WITH {DENSITY.format(group="label")},
    r AS (SELECT g, min(density) AS lo, max(density) AS hi, (max(density) - min(density)) / 8 AS raw FROM nodes GROUP BY g),
    q AS (SELECT *, pow(10.0, floor(log10(raw))) AS mag FROM r WHERE raw > 0),
    t AS (SELECT *, mag * list_min(list_filter({list(plots.STEPS)}, lambda v: v >= raw / mag - 1e-9)) AS step FROM q),
    l AS (SELECT g, k * step AS level FROM (SELECT *, unnest(range(floor(lo / step)::BIGINT, ceil(hi / step)::BIGINT + 1)) AS k FROM t) WHERE k * step > lo AND k * step < hi),
    c AS (SELECT a.g, a.i, a.j, a.gx AS lx, d.gx AS hx, a.gy AS ly, d.gy AS hy, a.density AS v00, b.density AS v10, e.density AS v01, d.density AS v11
          FROM nodes a JOIN nodes b ON b.g = a.g AND b.i = a.i + 1 AND b.j = a.j JOIN nodes e ON e.g = a.g AND e.i = a.i AND e.j = a.j + 1
          JOIN nodes d ON d.g = a.g AND d.i = a.i + 1 AND d.j = a.j + 1),
    s AS (SELECT c.*, level, lx + (level - v00) / (v10 - v00) * (hx - lx) AS lowx, ly + (level - v10) / (v11 - v10) * (hy - ly) AS righty, lx + (level - v01) / (v11 - v01) * (hx - lx) AS topx,
          ly + (level - v00) / (v01 - v00) * (hy - ly) AS lefty, v00 >= level AS a00, v10 >= level AS a10, v01 >= level AS a01, v11 >= level AS a11, (v00 + v10 + v01 + v11) / 4 >= level AS inside FROM c JOIN l USING (g)),
    f AS (SELECT *, list_filter([CASE WHEN a00 <> a10 THEN [lowx, ly] END, CASE WHEN a10 <> a11 THEN [hx, righty] END, CASE WHEN a01 <> a11 THEN [topx, hy] END, CASE WHEN a00 <> a01 THEN [lx, lefty] END], lambda e: e IS NOT NULL) AS ends FROM s),
    h AS (SELECT *, CASE WHEN len(ends) = 4 AND inside = a00 THEN [[ends[1], ends[2]], [ends[3], ends[4]]] WHEN len(ends) = 4 THEN [[ends[1], ends[4]], [ends[2], ends[3]]] ELSE [ends] END AS pieces FROM f WHERE len(ends) > 0),
    z AS (SELECT *, unnest(range(len(pieces))) AS piece FROM h)
    SELECT g AS label, round(level, 6) AS level, i, j, piece, round(pieces[piece + 1][1][1], 6) AS x1, round(pieces[piece + 1][1][2], 6) AS y1, round(pieces[piece + 1][2][1], 6) AS x2, round(pieces[piece + 1][2][2], 6) AS y2 FROM z"""
K_DISTANCES = """WITH n AS (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    f AS (SELECT vec_id, d AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM n)
    SELECT row_number() OVER (ORDER BY distance, vec_id) - 1 AS place, vec_id, round(distance, 6) AS distance FROM f WHERE k = 5"""


def _heatmap(s: SparkSession, d: str) -> DataFrame:
    long = stats.to_long(_kept(s, d), ["genotype"], HEAT)
    return rounded(stats.medians(long, "genotype").groupBy("genotype").pivot("feature", HEAT).agg(F.first("median")))


def _gappy(s: SparkSession, d: str) -> DataFrame:
    """Readings some of whose channels have no genotype or a treatment of NA."""
    r = adapter.readings(s, d)
    return r.withColumns({"genotype": F.when(F.col("channel") % 5 > 0, F.col("genotype")), "treatment": F.when(F.col("channel") % 7 == 3, " NA ").otherwise(F.col("treatment"))})


def _mirrored(s: SparkSession, d: str) -> DataFrame:
    """Pairs in both directions, named "a vs b"."""
    side = lambda a, b, delta: F.struct(F.concat_ws(" vs ", a, b).alias("comparison"), delta.alias("delta"))
    both = F.array(side("g1", "g2", F.col("delta")), side("g2", "g1", -F.col("delta")))
    return rounded(stats.cliffs_delta(statistics.long(s, d), "sex").select("feature", F.inline(both)))


def _rankings(s: SparkSession, d: str) -> DataFrame:
    """Two rankings of features side by side: by mean and by deviation."""
    got = statistics.long(s, d).groupBy("feature").agg(F.round(F.avg("value"), 4).alias("m"), F.round(F.stddev_samp("value"), 4).alias("sd"))
    first = order.numbered(got, [F.desc("m"), "feature"], "rank").select((F.col("rank") + 1).alias("rank"), "feature", F.col("m").alias("importance"))
    both = ml.ranking_table(first, got.select("feature", F.col("sd").alias("loading")))
    return both.select(F.col("rank").cast("long").alias("rank"), F.col("forest_feature").alias("by_mean"), F.col("pca_feature").alias("by_deviation"))


def _near_death(s: SparkSession, d: str) -> DataFrame:
    rows = sliding.near_death(sliding.sliding_rows(core.watched(s, d), core.days(s, d), core.BIN, core.THRESHOLD), 2)
    return rows.groupBy("status", "near_death").agg(F.count(F.lit(1)).alias("n"))


def _confusion(s: SparkSession, d: str) -> DataFrame:
    rows = ml._labelled(_points(s, d))
    return ml.confusion(ml.fit_forest(rows.where("part = 'train'")).transform(rows.where("part = 'test'")))


def _permuted(s: SparkSession, d: str) -> DataFrame:
    rows = ml._labelled(_points(s, d))
    return rounded(ml.permutation_importance(ml.fit_forest(rows.where("part = 'train'")), rows.where("part = 'test'")))


def _shap(s: SparkSession, d: str) -> DataFrame:
    rows = ml._labelled(_points(s, d))
    train = rows.where("part = 'train'")
    return rounded(ml.shap_importance(ml.fit_forest(train), train, rows.where("part = 'test'"), "vec_id"), 6)


def _any_type(s: SparkSession, d: str) -> DataFrame:
    """Fly-hours in which movement, contact or position is above nothing; values count from 300 on."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("reading_type") == kind, F.greatest(F.col("value") - 300, F.lit(0.0)))), F.lit(0.0))
    hours = adapter.readings(s, d).groupBy("fly_id", "exp_day", "zt").agg(*[of(k).alias(k.lower()) for k in READING_TYPES])
    return rounded(hours.where("mt > 0 or ct > 0 or pn > 0"))


def _automatic_range(s: SparkSession, d: str) -> DataFrame:
    """Readings of the five days that follow the first one, whichever that is."""
    r = adapter.readings(s, d)
    first = r.agg(F.min("date").alias("_first"))
    return r.join(F.broadcast(first), F.col("date").between(F.date_add("_first", 1), F.date_add("_first", 5))).select("event_id", "fly_id")


def _readings_flies(s: SparkSession, d: str) -> DataFrame:
    """Readings and flies as bucketed tables, joined without moving either."""
    r = adapter.readings(s, d)
    with_flies = store.with_flies(store.bucketed(r.select("fly_id", "event_id", "reading_type", "value"), "readings"), store.bucketed(r.select(*FLY).distinct(), "flies"))
    return rounded(with_flies.groupBy("genotype", "sex", "reading_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


def _health_flies(s: SparkSession, d: str) -> DataFrame:
    report = health.health_report(core.days(s, d)).select("fly_id", "final_status")
    flies = core.watched(s, d).select(*FLY).distinct()
    return store.with_flies(store.bucketed(report, "health"), store.bucketed(flies, "flies")).select("fly_id", "genotype", "final_status")


def _features_flies(s: SparkSession, d: str) -> DataFrame:
    kept = cut(_kept(s, d))
    both = store.with_flies(store.bucketed(kept.select("fly_id", "total_sleep_mean"), "features"), store.bucketed(kept.select(*FLY), "flies"))
    return rounded(both.groupBy("genotype", "treatment").agg(F.count(F.lit(1)).alias("n"), F.avg("total_sleep_mean").alias("sleep")))


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of components keep the columns of their rows."""
    rows, _, _ = ml.pca(_points(s, d), "embedding", 2)
    return rows.where(F.size("scores") == 2).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))


TRAILING = f"WITH {DENSE}, w AS (SELECT fly_id, datetime + INTERVAL 1 HOUR AS e, sum(n) OVER f AS s, avg(n) OVER f AS m, var_samp(n) OVER f AS v, count(*) OVER f AS k FROM dense WINDOW f AS (PARTITION BY fly_id ORDER BY datetime RANGE BETWEEN INTERVAL {{hours}} HOURS - INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)) SELECT fly_id, e::DATE::VARCHAR AS window_end_date, round(s::DOUBLE, 4) AS total_activity, round(m, 4) AS activity_mean, round(v, 4) AS activity_var FROM w WHERE hour(e) = 9 AND k = {{hours}}"
VALUES = "(SELECT feature, round(avg(value), 4) AS m, round(stddev_samp(value), 4) AS sd FROM lng GROUP BY feature)"
QUERIES = {
    "prj4_fly_keys": (lambda s, d: adapter.readings(s, d).select("fly_id", tp.fly_key(F.col("monitor"), F.col("channel")).alias("fly_key")).distinct(), f"WITH {E} SELECT DISTINCT fly_id, monitor || '-ch' || channel AS fly_key FROM e"),
    "prj7_harmonics": (lambda s, d: rounded(adapter.readings(s, d).select("zt", tp.harmonic(F.col("zt"))[0].alias("c"), tp.harmonic(F.col("zt"))[1].alias("s")).distinct().select("zt", (F.round("c", 6) + 0.0).alias("c"), (F.round("s", 6) + 0.0).alias("s")), 6), f"WITH {E} SELECT DISTINCT zt::BIGINT AS zt, round(cos(2 * pi() * zt / 24), 6) + 0.0 AS c, round(sin(2 * pi() * zt / 24), 6) + 0.0 AS s FROM e"),
    "prj9_heatmap": (_heatmap, f"WITH {GOOD} SELECT genotype, {', '.join(f'round(median({c})::DOUBLE, 4) AS {c}' for c in HEAT)} FROM kept GROUP BY genotype"),
    "prj13_mirrored_pairs": (_mirrored, f"WITH {statistics.LONG} SELECT x.feature, x.sex || ' vs ' || y.sex AS comparison, round(avg(sign(x.value - y.value)), 4) AS delta FROM lng x JOIN lng y ON x.feature = y.feature AND x.sex <> y.sex GROUP BY ALL"),
    "flt2_active_bins": (lambda s, d: adapter.dense(s, d).where("n > 0").groupBy("fly_id").agg(F.count(F.lit(1)).alias("n")), f"WITH {DENSE} SELECT fly_id, count(*) AS n FROM dense WHERE n > 0 GROUP BY fly_id"),
    "flt3_date_range": (lambda s, d: adapter.readings(s, d).where(F.col("date").between("2024-01-05", "2024-01-10")).select("event_id", "fly_id"), f"WITH {E} SELECT event_id, fly_id FROM e WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'"),
    "flt2_any_type_active": (_any_type, f"WITH {E} SELECT fly_id, exp_day::BIGINT AS exp_day, zt::BIGINT AS zt, round(coalesce(sum(greatest(value - 300, 0)) FILTER (reading_type = 'MT'), 0), 4) AS mt, round(coalesce(sum(greatest(value - 300, 0)) FILTER (reading_type = 'CT'), 0), 4) AS ct, round(coalesce(sum(greatest(value - 300, 0)) FILTER (reading_type = 'Pn'), 0), 4) AS pn FROM e GROUP BY ALL HAVING mt > 0 OR ct > 0 OR pn > 0"),
    "flt3_automatic_range": (_automatic_range, f"WITH {E} SELECT event_id, fly_id FROM e WHERE date BETWEEN (SELECT min(date) + 1 FROM e) AND (SELECT min(date) + 5 FROM e)"),
    "join15_scores_keep_columns": (_scores, "SELECT label, count(*) AS n, min(vec_id) AS least, max(vec_id) AS most FROM embeddings GROUP BY label"),
    "srt3_by_p": (lambda s, d: order.numbered(statistics._bh(s, d), ["p_adj", "feature"]).select("feature", (F.col("place") + 1).alias("place")), f"WITH {statistics.ANOVA}, p AS (SELECT feature, round(p_value, 6) AS p_value FROM anova), q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, feature) AS q FROM p), r AS (SELECT feature, round(least(1, min(q) OVER (ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)), 4) AS p_adj FROM q) SELECT feature, row_number() OVER (ORDER BY p_adj, feature) AS place FROM r"),
    "srt1_multi_key": (lambda s, d: order.numbered(core.days(s, d).select("fly_id", "exp_day"), ["fly_id", "exp_day"]).withColumn("place", F.col("place") + 1), f"WITH {core.HEALTH} SELECT fly_id, exp_day::BIGINT AS exp_day, row_number() OVER (ORDER BY fly_id, exp_day) AS place FROM fin"),
    "src9_readings_flies": (_readings_flies, f"WITH {E} SELECT genotype, sex, reading_type, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY ALL"),
    "src10_health_flies": (_health_flies, f"WITH {core.HEALTH} SELECT report.fly_id, report.genotype, report.final_status FROM report"),
    "src11_features_flies": (_features_flies, f"WITH {GOOD} SELECT genotype, treatment, count(*) AS n, round(avg(total_sleep_mean)::DOUBLE, 4) AS sleep FROM kept GROUP BY ALL"),
    "flt4_mt_without_days": (lambda s, d: adapter.readings(s, d).where("reading_type = 'MT' and exp_day not in (1, 7)").select("event_id", "fly_id"), f"WITH {E} SELECT event_id, fly_id FROM e WHERE reading_type = 'MT' AND exp_day NOT IN (1, 7)"),
    "flt5_usable_metadata": (lambda s, d: _gappy(s, d).where(tp.is_ok(F.col("genotype")) & tp.is_ok(F.col("sex")) & tp.is_ok(F.col("treatment"))).groupBy("genotype", "sex", "treatment").agg(F.count_distinct("fly_id").alias("n")), f"WITH {E} SELECT genotype, sex, treatment, count(DISTINCT fly_id) AS n FROM e WHERE channel % 5 > 0 AND channel % 7 <> 3 GROUP BY ALL"),
    "flt6_usable_rows": (lambda s, d: features.usable_rows(_gappy(s, d).withColumn("zt", F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("zt").cast("string")))).groupBy("fly_id").agg(F.count(F.lit(1)).alias("n"), F.sum("zt").alias("zts")), f"WITH {E} SELECT fly_id, count(*) AS n, sum(zt)::BIGINT AS zts FROM e WHERE channel % 5 > 0 AND event_id % 11 <> 0 GROUP BY fly_id"),
    "flt11_vehicle": (lambda s, d: adapter.readings(s, d).where(F.upper("treatment") == "VEH").select("fly_id").distinct(), f"WITH {E} SELECT DISTINCT fly_id FROM e WHERE upper(treatment) = 'VEH'"),
    "flt15_group_sizes": (lambda s, d: _kept(s, d).groupBy("genotype", "treatment").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), f"WITH {GOOD} SELECT genotype, treatment, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 3"),
    "flt16_sex_prefix": (lambda s, d: _kept(s, d).where(F.lower("sex").startswith("f")).select("fly_id"), f"WITH {GOOD} SELECT fly_id FROM kept WHERE lower(sex) LIKE 'f%'"),
    "flt18_significant": (lambda s, d: statistics._bh(s, d).where("p_adj < 0.9").select("feature"), f"WITH {statistics.ANOVA}, p AS (SELECT feature, round(p_value, 6) AS p_value FROM anova), q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, feature) AS q FROM p), r AS (SELECT feature, round(least(1, min(q) OVER (ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)), 4) AS p_adj FROM q) SELECT feature FROM r WHERE p_adj < 0.9"),
    "agg13_max_by_type": (lambda s, d: rounded(adapter.readings(s, d).groupBy("fly_id", "reading_type").agg(F.max("value").alias("most"))), f"WITH {E} SELECT fly_id, reading_type, round(max(value), 4) AS most FROM e GROUP BY ALL"),
    "agg14_distinct_flies": (lambda s, d: rounded(adapter.readings(s, d).groupBy("fly_id", "monitor", "channel").agg(F.count_distinct("date").alias("n_dates"))), f"WITH {E} SELECT fly_id, monitor, channel::BIGINT AS channel, count(DISTINCT date) AS n_dates FROM e GROUP BY ALL"),
    "agg21_ever_positive": (lambda s, d: adapter.readings(s, d).groupBy("fly_id").agg(F.bool_or(F.col("value") > 400).alias("ever")), f"WITH {E} SELECT fly_id, bool_or(value > 400) AS ever FROM e GROUP BY fly_id"),
    "agg22_squared_loadings": (lambda s, d: rounded(_points(s, d).select("vec_id", F.aggregate(F.slice(F.col("embedding").cast("array<double>"), 1, 8), F.lit(0.0), lambda a, x: a + x * x).alias("s"))), "SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE)), 4) AS s FROM embeddings"),
    "agg23_value_counts": (lambda s, d: _events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")), "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "win11_rolling_mean": (lambda s, d: rounded(core.hourly(s, d).select("fly_id", "exp_day", "zt", F.avg("hourly_mt").over(Window.partitionBy("fly_id", "exp_day").orderBy("zt").rowsBetween(-1, 1)).alias("smooth")), 6), f"WITH {HOURLY} SELECT fly_id, exp_day::BIGINT AS exp_day, zt::BIGINT AS zt, round(avg(y) OVER (PARTITION BY fly_id, exp_day ORDER BY zt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM hourly"),
    "win21_group_transform": (lambda s, d: rounded(_kept(s, d).select("fly_id", F.count(F.lit(1)).over(Window.partitionBy("genotype")).alias("n"), F.avg("total_sleep_mean").over(Window.partitionBy("genotype")).alias("m"))), f"WITH {GOOD} SELECT fly_id, count(*) OVER (PARTITION BY genotype) AS n, round((avg(total_sleep_mean) OVER (PARTITION BY genotype))::DOUBLE, 4) AS m FROM kept"),
    "srt2_key_order": (lambda s, d: order.numbered(adapter.readings(s, d).select("monitor", "channel").distinct(), [F.col("monitor").cast("int"), "channel"]).select(F.concat_ws("-", "monitor", "channel").alias("key"), (F.col("place") + 1).alias("place")), f"WITH {E} SELECT monitor || '-' || channel AS key, row_number() OVER (ORDER BY monitor::INTEGER, channel) AS place FROM (SELECT DISTINCT monitor, channel FROM e)"),
    "srt5_latest": (lambda s, d: store.latest(_events(s, d).select(F.col("event_id").alias("experiment_id"), F.col("ts").alias("created_at"))).select(F.col("experiment_id").alias("event_id")), "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1"),
    "srt6_sample": (lambda s, d: _events(s, d).orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("event_id").cast("string"))), "event_id").limit(500).select("event_id"), "SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500"),
    "set1_concat": (lambda s, d: functools.reduce(DataFrame.unionByName, [adapter.readings(s, d).where(F.col("reading_type") == k).select("event_id", "monitor", "reading_type") for k in READING_TYPES]), f"WITH {E} SELECT event_id, monitor, reading_type FROM e"),
    "set4_unique_values": (lambda s, d: adapter.readings(s, d).select("genotype", "treatment").distinct(), f"WITH {E} SELECT DISTINCT genotype, treatment FROM e"),
    "join13_group_pairs": (lambda s, d: (lambda g: g.join(g.withColumnRenamed("g1", "g2"), F.col("g1") < F.col("g2")))(adapter.readings(s, d).select(F.col("genotype").alias("g1")).distinct()), f"WITH {E}, g AS (SELECT DISTINCT genotype AS g FROM e) SELECT a.g AS g1, b.g AS g2 FROM g a JOIN g b ON a.g < b.g"),
    "join17_anti_semi": (lambda s, d: adapter.readings(s, d).join(adapter.readings(s, d).where("value > 450").select("fly_id").distinct(), "fly_id", "left_anti").select("event_id"), f"WITH {E} SELECT event_id FROM e WHERE fly_id NOT IN (SELECT fly_id FROM e WHERE value > 450)"),
    "join19_two_rankings": (_rankings, f"WITH {statistics.LONG}, v AS {VALUES}, a AS (SELECT row_number() OVER (ORDER BY m DESC, feature) AS rank, feature AS by_mean FROM v), b AS (SELECT row_number() OVER (ORDER BY sd DESC, feature) AS rank, feature AS by_deviation FROM v) SELECT rank, by_mean, by_deviation FROM a FULL JOIN b USING (rank)"),
    "sta20_stability_grid": (lambda s, d: rounded(ml.stability_grid(_points(s, d).orderBy("vec_id"), "vec_id", "embedding", "label")), None),
    "sta21_density_grid": (lambda s, d: rounded(plots.density(_plane(s, d), "x", "y").select("gx", "gy", "density"), 6), f"WITH {DENSITY.format(group='NULL::INTEGER')} SELECT round(gx, 6) AS gx, round(gy, 6) AS gy, round(density, 6) AS density FROM nodes"),
    "sta21_density_by_label": (lambda s, d: rounded(plots.density(_plane(s, d), "x", "y", "label"), 6), f"WITH {DENSITY.format(group='label')} SELECT g AS label, i, j, round(gx, 6) AS gx, round(gy, 6) AS gy, round(density, 6) AS density FROM nodes"),
    "sta21_contours": (lambda s, d: rounded(plots.contours(cut(plots.density(_plane(s, d), "x", "y", "label")), "label"), 6), CONTOURS),
    "snk11_k_distances": (lambda s, d: rounded(plots.k_distances(cluster.knn(_points(s, d), "vec_id", "embedding", 6), 5, "vec_id"), 6), K_DISTANCES),
    "snk11_shares": (lambda s, d: rounded(plots.shares(_kept(s, d), "genotype", "treatment")), f"WITH {GOOD} SELECT genotype, treatment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY genotype), 4) AS share FROM kept GROUP BY genotype, treatment"),
    "snk11_scree": (_scree, None),
    "ml2_umap": (lambda s, d: rounded(ml.umap(_points(s, d), "vec_id", "embedding")), None),
    "ml6_tuned_forest": (lambda s, d: rounded(ml.tuned_report(_points(s, d))), None),
    "ml7_confusion": (_confusion, None),
    "ml11_permutation_importance": (_permuted, None),
    "src13_trailing_day": (lambda s, d: rounded(sliding.trailing(adapter.dense(s, d), core.BIN)), TRAILING.format(hours=24)),
    "src13_trailing_two_days": (lambda s, d: rounded(sliding.trailing(adapter.dense(s, d), core.BIN, 48)), TRAILING.format(hours=48)),
    "ml11_shap_importance": (_shap, None),
    "ml12_near_death": (_near_death, None),
}
