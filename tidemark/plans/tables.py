"""Queries of the readers, stores, reshapes and five-minute states, and the same in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cluster, ml, sliding, states
from tidemark.plans import core
from tidemark.plans.core import FLY_SQL, rounded
from tidemark.sources import adapter, monitor, store


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Monitor lines made of the events: one for each monitor, hour and reading type, 32 counts each."""
    e = adapter.readings(spark, d).select("monitor", "channel", F.date_trunc("hour", F.col("datetime").cast("timestamp")).alias("t"), "reading_type")
    wide = e.groupBy("monitor", "t", "reading_type").pivot("channel", list(range(1, 33))).agg(F.count(F.lit(1))).na.fill(0)
    head = [F.lit("1"), F.date_format("t", "d MMM yy"), F.date_format("t", "HH:mm:ss"), F.lit("7"), F.lit("0"), F.lit("0"), F.lit("0"), F.col("reading_type"), F.lit("0"), F.lit("0")]
    return wide.select(F.concat_ws("\t", *head, *[F.col(str(i)).cast("string") for i in range(1, 33)]).alias("value"), "monitor")


LINES = f"""e AS (SELECT {FLY_SQL}, date_trunc('hour', ts) AS t, CASE event_type WHEN 'view' THEN 'MT' WHEN 'click' THEN 'CT' ELSE 'Pn' END AS kind FROM events),
    c AS (SELECT monitor, channel, t, kind, count(*) AS n FROM e GROUP BY ALL),
    k AS (SELECT DISTINCT monitor, channel, t FROM c), x AS (SELECT unnest(['MT', 'CT', 'Pn']) AS kind)"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monitor.to_readings(monitor.parse_lines(lines(spark, d))))


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return monitor.parse_lines(monitor.filter_lines(lines(spark, d), dt.date(2024, 1, 2), 5, 1)).groupBy("monitor", "movement_type").agg(F.count(F.lit(1)).alias("n"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the lines with the metadata of channels in use, by genotype and time of day."""
    meta = adapter.readings(spark, d).where("channel % 5 > 0").select("monitor", "channel", "fly_id", "genotype", "sex", "treatment").distinct()
    ready = monitor.prepare(monitor.to_readings(monitor.parse_lines(lines(spark, d))), meta, adapter.START)
    return rounded(ready.groupBy("genotype", "reading_type", "zt", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def _flies(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Customers as flies of an experiment, a nation each, and orders as their readings."""
    flies = _part(spark, d, "customer").select(F.col("c_nationkey").alias("experiment_id"), F.col("c_custkey").cast("string").alias("fly_id"))
    readings = _part(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("fly_id"), "o_orderkey").join(flies, "fly_id")
    return {"flies": flies, "readings": readings}


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = _flies(spark, d)
    return store.counts(store.delete_flies(tables, tables["flies"].where("fly_id like '%7'")))


def bins(spark: SparkSession, d: str) -> DataFrame:
    """Hours as bins: events are movement, the sum of values the variance. Some users make a fly, so that some flies live."""
    return adapter.dense(spark, d, users=core.USERS).select("fly_id", "genotype", "sex", "treatment", F.col("datetime").alias("bin_start"), F.col("n").alias("mt_sum"), F.col("value").alias("pn_var"))


DEATH, SHORT, ROLL, WARMUP = 18, 2, 48, 5
BINS = core.dense_sql(core.USERS) + f""", bins AS (SELECT fly_id, genotype, sex, treatment, datetime AS bin_start, n AS mt_sum, value AS pn_var FROM dense),
    s0 AS (SELECT *, mt_sum = 0 AND pn_var = 0 AS still FROM bins),
    s1 AS (SELECT *, CASE WHEN lag(still) OVER w IS DISTINCT FROM still THEN 1 ELSE 0 END AS o FROM s0 WINDOW w AS (PARTITION BY fly_id ORDER BY bin_start)),
    s2 AS (SELECT *, sum(o) OVER (PARTITION BY fly_id ORDER BY bin_start) AS run FROM s1),
    s3 AS (SELECT fly_id, run, min(bin_start) AS start FROM s2 WHERE still GROUP BY ALL HAVING count(*) >= {DEATH}),
    tod AS (SELECT fly_id, min(start) AS time_of_death FROM s3 GROUP BY fly_id),
    r0 AS (SELECT bins.*, CASE WHEN bin_start >= time_of_death THEN 'Dead' WHEN mt_sum = 0 THEN 'Sleep' ELSE 'Active' END AS st FROM bins LEFT JOIN tod USING (fly_id)),
    r1 AS (SELECT *, CASE WHEN lag(st) OVER w IS DISTINCT FROM st THEN 1 ELSE 0 END AS o FROM r0 WINDOW w AS (PARTITION BY fly_id ORDER BY bin_start)),
    r2 AS (SELECT *, sum(o) OVER (PARTITION BY fly_id ORDER BY bin_start) AS run FROM r1),
    rawst AS (SELECT * EXCLUDE (o, run), CASE WHEN st = 'Active' AND count(*) OVER (PARTITION BY fly_id, run) < {SHORT} THEN 'Sleep' ELSE st END AS raw_state FROM r2)"""
ROLLING = BINS + f""", f AS (SELECT *, raw_state = 'Active' AS act FROM rawst),
    g AS (SELECT *, sum(act::INTEGER) OVER (PARTITION BY fly_id ORDER BY bin_start) AS active_count,
        avg(mt_sum) FILTER (act) OVER b AS mm, stddev_samp(mt_sum) FILTER (act) OVER b AS ms, avg(pn_var) FILTER (act) OVER b AS pm, stddev_samp(pn_var) FILTER (act) OVER b AS ps,
        0.01 * stddev_samp(mt_sum) FILTER (act) OVER (PARTITION BY fly_id) AS mf, 0.01 * stddev_samp(pn_var) FILTER (act) OVER (PARTITION BY fly_id) AS pf
        FROM f WINDOW b AS (PARTITION BY fly_id ORDER BY bin_start ROWS BETWEEN {ROLL - 1} PRECEDING AND CURRENT ROW)),
    st AS (SELECT *, CASE WHEN NOT act THEN raw_state WHEN active_count < {WARMUP} THEN 'Warmup' WHEN coalesce(ms < mf OR ps < pf, false) THEN 'Low_Data' ELSE 'HMM_candidate' END AS state,
        CASE WHEN act THEN (mt_sum - mm) / nullif(greatest(ms, mf), 0) END AS mt_z, CASE WHEN act THEN (pn_var - pm) / nullif(greatest(ps, pf), 0) END AS pn_z FROM g)"""


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return states.rolling_states(states.raw_states(bins(spark, d), DEATH, SHORT), ROLL, WARMUP)


def _five(spark: SparkSession, d: str) -> DataFrame:
    b = bins(spark, d)
    long = b.select("fly_id", "genotype", "sex", "treatment", F.col("bin_start").alias("datetime"), F.col("mt_sum").cast("double").alias("MT"), F.col("pn_var").alias("Pn")).unpivot(["fly_id", "genotype", "sex", "treatment", "datetime"], ["MT", "Pn"], "reading_type", "value")
    return rounded(states.five_minute_bins(long, 6, 360), 6)


def _part(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _part(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    return c.where("c_acctbal < 6000"), c.where("c_acctbal >= 3000").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))


def _plane(spark: SparkSession, d: str) -> DataFrame:
    """The first two components of the embeddings."""
    return _part(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("v"))


def _plane_clusters(spark: SparkSession, d: str) -> DataFrame:
    points = _plane(spark, d)
    bend = cluster.elbow(cluster.knn(points, "vec_id", "v", 6).where("k = 5"), "distance").first()
    return cluster.dbscan(points, "vec_id", "v", bend["distance"] / 3 if bend else 0.0, 6)


#: Density clusters by all pairs and the closure of the core points' links; {eps} may read the bends of the fifth neighbours' distances.
DBSCAN = """WITH RECURSIVE p AS ({points}), pair AS (SELECT a.k AS a, b.k AS b, list_distance(a.v, b.v) AS d FROM p a, p b),
    ranked AS (SELECT d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM pair), fifth AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM ranked WHERE n = 6),
    bent AS (SELECT d, i, lead(d, 2) OVER (ORDER BY d) - 2 * lead(d) OVER (ORDER BY d) + d AS bend FROM fifth QUALIFY bend IS NOT NULL),
    near AS (SELECT a, b FROM pair WHERE d <= {eps}), core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 6),
    link AS (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
    reach(node, root) AS (SELECT k, k FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node WHERE r.root < l.b),
    root AS (SELECT node, min(root) AS root FROM reach GROUP BY node), name AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
    beside AS (SELECT a, min(cluster) AS cluster FROM near JOIN name ON b = node GROUP BY a),
    found AS (SELECT k, coalesce(name.cluster, beside.cluster, -1) AS cluster FROM p LEFT JOIN name ON k = node LEFT JOIN beside ON k = a)"""
OLD_NEW = "o AS (SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE round(c_acctbal, 2) < 6000), n AS (SELECT c_custkey, c_mktsegment, round(round(c_acctbal, 2) + 1, 2) AS c_acctbal FROM customer WHERE round(c_acctbal, 2) >= 3000)"
QUERIES = {
    "src1_monitor_readings": (_readings, f"WITH {LINES}, w AS (SELECT k.monitor, k.channel, k.t, x.kind, coalesce(n, 0) AS n FROM k, x LEFT JOIN c ON c.monitor = k.monitor AND c.channel = k.channel AND c.t = k.t AND c.kind = x.kind) SELECT monitor, strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime, channel::BIGINT AS channel, kind AS reading_type, n::BIGINT AS value FROM w"),
    "src5_filtered_lines": (_filtered, f"WITH {LINES} SELECT monitor, kind AS movement_type, count(*) AS n FROM (SELECT DISTINCT monitor, t, kind FROM c WHERE t >= TIMESTAMP '2024-01-03 09:00:00' AND t < TIMESTAMP '2024-01-08 09:00:00') GROUP BY ALL"),
    "agg15_bins": (_five, "WITH " + BINS.split(",\n    s0 AS")[0] + " SELECT fly_id, genotype, sex, treatment, strftime(time_bucket(INTERVAL 6 HOUR, bin_start, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bin_start, sum(mt_sum)::DOUBLE AS mt_sum, round(coalesce(var_samp(pn_var), 0), 6) AS pn_var FROM bins GROUP BY fly_id, genotype, sex, treatment, time_bucket(INTERVAL 6 HOUR, bin_start, TIMESTAMP '1970-01-01') HAVING count(*) = 6"),
    "win14_time_of_death": (lambda s, d: rounded(states.time_of_death(bins(s, d), DEATH)), f"WITH {BINS} SELECT fly_id, strftime(time_of_death, '%Y-%m-%d %H:%M:%S') AS time_of_death FROM tod"),
    "win16_raw_states": (lambda s, d: rounded(states.raw_states(bins(s, d), DEATH, SHORT).select("fly_id", "bin_start", "raw_state")), f"WITH {BINS} SELECT fly_id, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start, raw_state FROM rawst"),
    "win17_rolling_states": (lambda s, d: rounded(rolled(s, d).select("fly_id", "bin_start", "state", "mt_z", "pn_z")), f"WITH {ROLLING} SELECT fly_id, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start, state, round(mt_z, 4) AS mt_z, round(pn_z, 4) AS pn_z FROM st"),
    "win18_gap_bouts": (lambda s, d: rounded(states.gap_bouts(adapter.readings(s, d), ["fly_id"], gap_minutes=120)), f"WITH e AS (SELECT {FLY_SQL}, ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 120 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM e WINDOW w AS (PARTITION BY fly_id ORDER BY ts)), b AS (SELECT *, sum(o) OVER (PARTITION BY fly_id ORDER BY ts)::BIGINT AS bout FROM g) SELECT fly_id, bout, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM b GROUP BY fly_id, bout"),
    "agg19_state_shares": (lambda s, d: rounded(states.state_shares(rolled(s, d)).select("fly_id", "n_bins", "pct_dead", "pct_sleep", "first_warmup"), 1), f"WITH {ROLLING} SELECT fly_id, count(*) AS n_bins, round_even(avg((state = 'Dead')::INTEGER) * 100, 1) AS pct_dead, round_even(avg((state = 'Sleep')::INTEGER) * 100, 1) AS pct_sleep, strftime(min(CASE WHEN state = 'Warmup' THEN bin_start END), '%Y-%m-%d %H:%M:%S') AS first_warmup FROM st GROUP BY fly_id"),
    "agg20_quality_summary": (lambda s, d: rounded(states.quality_summary(states.quality_table(rolled(s, d))), 1), f"WITH {ROLLING}, q AS (SELECT fly_id, genotype, round_even(avg((state = 'Dead')::INTEGER) * 100, 1) AS d, round_even(avg((state = 'Sleep')::INTEGER) * 100, 1) AS s FROM st GROUP BY ALL), k AS (SELECT genotype, CASE WHEN d > 0 THEN 'Exclude' ELSE 'Keep' END AS decision, count(*) AS n, round(median(d), 1) AS median_dead, round(median(s), 1) AS median_sleep FROM q GROUP BY ALL) SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY genotype), 1)::DOUBLE AS percent FROM k"),
    "join16_candidate_bouts": (lambda s, d: rounded(states.candidate_bouts(rolled(s, d), 120, 2).select("fly_id", "bin_start", "bout")), f"WITH {ROLLING}, cb AS (SELECT fly_id, bin_start, CASE WHEN bin_start - lag(bin_start) OVER w > INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS o FROM st WHERE state = 'HMM_candidate' WINDOW w AS (PARTITION BY fly_id ORDER BY bin_start)), b AS (SELECT *, sum(o) OVER (PARTITION BY fly_id ORDER BY bin_start) AS run FROM cb) SELECT fly_id, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start, 1 + run::BIGINT - min(run) OVER (PARTITION BY fly_id)::BIGINT AS bout FROM b QUALIFY count(*) OVER (PARTITION BY fly_id, run) >= 2"),
    "ml14_quality_after_model": (lambda s, d: rounded(states.quality_table(states.with_decoded(rolled(s, d), states.hmm_states(rolled(s, d)))).groupBy("genotype", "decision").agg(F.count(F.lit(1)).alias("n"))), None),
    "ml13_hmm_states": (lambda s, d: rounded(states.hmm_states(rolled(s, d))), None),
    "win_sliding_rows": (lambda s, d: rounded(sliding.sliding_rows(core.watched(s, d), core.days(s, d), core.BIN, core.THRESHOLD)), None),
    "snk3_insert_ignore": (lambda s, d: store.insert_ignore(*_old_new(s, d), ["c_custkey"]), f"WITH {OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)"),
    "snk4_upsert": (lambda s, d: store.upsert(*_old_new(s, d), ["c_custkey"]), f"WITH {OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)"),
    "snk7_delete": (lambda s, d: store.delete(*_old_new(s, d), ["c_custkey"]), f"WITH {OLD_NEW} SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)"),
    "snk7_delete_flies": (_cascade, "WITH f AS (SELECT c_nationkey AS experiment_id, c_custkey FROM customer WHERE c_custkey::VARCHAR NOT LIKE '%7') SELECT experiment_id, 'flies' AS \"table\", count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT experiment_id, 'readings', count(*) FROM f JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "snk8_counts": (lambda s, d: store.counts(_flies(s, d)), "SELECT c_nationkey AS experiment_id, 'flies' AS \"table\", count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'readings', count(*) FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "join1_prepared": (_prepared, f"WITH {LINES}, m AS (SELECT DISTINCT monitor, channel, genotype FROM e WHERE channel % 5 > 0), w AS (SELECT k.monitor, k.channel, k.t, x.kind, coalesce(n, 0) AS n FROM k, x LEFT JOIN c ON c.monitor = k.monitor AND c.channel = k.channel AND c.t = k.t AND c.kind = x.kind) SELECT genotype, kind AS reading_type, ((hour(t) + 15) % 24)::BIGINT AS zt, CASE WHEN (hour(t) + 15) % 24 < 12 THEN 'Light' ELSE 'Dark' END AS phase, count(*) AS n, sum(n)::BIGINT AS total FROM w JOIN m USING (monitor, channel) GROUP BY ALL"),
    "set2_difference": (lambda s, d: _old_new(s, d)[0].select("c_custkey").exceptAll(_old_new(s, d)[1].select("c_custkey")), f"WITH {OLD_NEW} SELECT c_custkey FROM o EXCEPT ALL SELECT c_custkey FROM n"),
    "set3_union": (lambda s, d: _old_new(s, d)[0].select("c_mktsegment").union(_old_new(s, d)[1].select("c_mktsegment")).distinct(), f"WITH {OLD_NEW} SELECT c_mktsegment FROM o UNION SELECT c_mktsegment FROM n"),
    "join5_fact_dimension": (lambda s, d: rounded(_part(s, d, "orders").join(_part(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2), "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "src17_listing_difference": (lambda s, d: store.listing_difference(*[t.select(F.col("c_custkey").cast("string").alias("path"), F.col("c_acctbal").alias("size")) for t in _old_new(s, d)]).groupBy("state").agg(F.count(F.lit(1)).alias("n")), f"WITH {OLD_NEW} SELECT CASE WHEN n.c_custkey IS NULL THEN 'push' WHEN o.c_custkey IS NULL THEN 'pull' WHEN o.c_acctbal <> n.c_acctbal THEN 'differs' ELSE 'same' END AS state, count(*) AS n FROM o FULL JOIN n ON o.c_custkey = n.c_custkey GROUP BY 1"),
    "ml1_pca_variance": (lambda s, d: ml.pca_variance(_part(s, d, "embeddings"), "embedding"), None),
    "ml4_dbscan": (lambda s, d: ml.dbscan_sizes(_part(s, d, "embeddings")), DBSCAN.format(points="SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings", eps="(SELECT d FROM bent ORDER BY bend DESC, i LIMIT 1)") + " SELECT cluster, count(*) AS n FROM found GROUP BY cluster"),
    "ml4_dbscan_plane": (_plane_clusters, DBSCAN.format(points="SELECT vec_id AS k, embedding[1:2]::DOUBLE[] AS v FROM embeddings", eps="(SELECT d FROM bent ORDER BY bend DESC, i LIMIT 1) / 3") + " SELECT k AS vec_id, cluster FROM found"),
    "ml3_neighbours_plane": (lambda s, d: rounded(cluster.knn(_plane(s, d), "vec_id", "v", 4), 6), "SELECT vec_id, k, round(distance, 6) AS distance FROM (SELECT a.vec_id, list_distance(a.embedding[1:2]::DOUBLE[], b.embedding[1:2]::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding[1:2]::DOUBLE[], b.embedding[1:2]::DOUBLE[]), b.vec_id) - 1 AS k FROM embeddings a, embeddings b) WHERE k < 4"),
    "win20_elbow": (lambda s, d: rounded(ml.elbow_of(_part(s, d, "embeddings"))), "WITH k AS (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS n FROM embeddings a, embeddings b), s AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM k WHERE n = 6), t AS (SELECT d, i, lead(d, 2) OVER (ORDER BY d) - 2 * lead(d) OVER (ORDER BY d) + d AS bend FROM s) SELECT i::BIGINT AS index, round(d, 4) AS distance FROM t WHERE bend IS NOT NULL ORDER BY bend DESC, i LIMIT 1"),
    "ml6_forest_metrics": (lambda s, d: rounded(ml.forest_report(_part(s, d, "embeddings"))), None),
    "ml8_forest_importance": (lambda s, d: rounded(ml.forest_importance(_part(s, d, "embeddings"))), None),
    "ml10_boosted_metrics": (lambda s, d: rounded(ml.boosted_report(_part(s, d, "embeddings"))), None),
    "ml10_boosted_three_classes": (lambda s, d: rounded(ml.boosted_report(_part(s, d, "embeddings"), 3)), None),
    "ml5_hdbscan_sizes": (lambda s, d: ml.hdbscan(_part(s, d, "embeddings"), "vec_id", "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), None),
    "ml9_group_split": (lambda s, d: ml.group_split(adapter.readings(s, d), "fly_id", F.lit("all")).groupBy("part").agg(F.count_distinct("fly_id").alias("n")), f"WITH f AS (SELECT DISTINCT fly_id FROM (SELECT {FLY_SQL} FROM events)), p AS (SELECT row_number() OVER (ORDER BY md5('42:' || fly_id), fly_id) / count(*) OVER () AS place FROM f) SELECT CASE WHEN place <= 0.8 THEN 'train' WHEN place <= 0.9 THEN 'val' ELSE 'test' END AS part, count(*) AS n FROM p GROUP BY 1"),
}
