"""Queries of the statistics over the clean feature table and the embeddings, and the same in DuckDB's SQL.

Groups are treatments, of which there are three, so that the tails of F and chi-square have a closed form in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import native
from tidemark.operators import cluster, stats
from tidemark.plans.core import ALL_NAMES, GOOD, _kept, rounded
from tidemark.schemas import FEATURE_LABELS
from tidemark.sources import files

IDS = ["fly_id", "genotype", "sex", "treatment"]


def long(spark: SparkSession, d: str) -> DataFrame:
    """(fly_id, genotype, sex, treatment, feature, value) of flies without problems; missing values are left out.

    Values are rounded, so that equal ones tie whatever the order of their sums.
    """
    return stats.to_long(_kept(spark, d), IDS, ALL_NAMES).withColumn("value", F.round("value", 6))


LONG = GOOD + ", lng AS (" + " UNION ALL ".join(f"SELECT fly_id, genotype, sex, treatment, '{c}' AS feature, round({c}::DOUBLE, 6) AS value FROM kept WHERE {c} IS NOT NULL" for c in ALL_NAMES) + ")"
RANKS = LONG + """, rk AS (SELECT *, count(*) OVER (PARTITION BY feature, value) AS ties,
    rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS mid_rank FROM lng)"""
ANOVA = LONG + """, g AS (SELECT feature, treatment, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM lng GROUP BY ALL),
    a AS (SELECT feature, count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS gm, sum(n * v) AS ssw FROM g GROUP BY feature),
    b AS (SELECT feature, sum(g.n * (m - gm) * (m - gm)) AS ssb FROM g JOIN a USING (feature) GROUP BY feature),
    f AS (SELECT a.feature, k, n, (ssb / (k - 1)) / nullif(ssw / (n - k), 0) AS f, ssb / nullif(ssb + ssw, 0) AS eta_squared FROM a JOIN b USING (feature) WHERE k >= 2 AND n > k),
    anova AS (SELECT *, pow(1 + 2 * f / (n - k), -(n - k) / 2.0) AS p_value FROM f)"""
KRUSKAL = RANKS + """, g AS (SELECT feature, treatment, count(*) AS n, sum(mid_rank) AS r, sum(ties * ties - 1) AS t FROM rk GROUP BY ALL),
    o AS (SELECT feature, count(*) AS k, sum(n)::DOUBLE AS n, sum(r * r / n) AS s, sum(t)::DOUBLE AS t FROM g GROUP BY feature),
    h AS (SELECT feature, k, n, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / nullif(1 - t / (n * n * n - n), 0) AS h FROM o WHERE k >= 2)"""


def _normal_p(z: str) -> str:
    """Two-sided p of a normal value, by quadrature from 0 to it."""
    nodes = ", ".join(f"{{'t': {(t + 1) / 2!r}::DOUBLE, 'w': {w / 2!r}::DOUBLE}}" for t, w in native.legendre(40))
    return f"greatest(0, 1 - 2 * abs({z}) * list_sum(list_transform([{nodes}], lambda v: v.w * exp(-({z}) * ({z}) * v.t * v.t / 2))) / sqrt(2 * pi()))"


def _values(nodes: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" for x in v) + ")" for v in nodes)


#: Tails of the studentised range of three groups for the rows of ``t`` (feature, g1, g2, q, df), by quadrature over both integrals.
TUKEY_TAIL = f""", zn(z, w, p) AS (VALUES {_values([(8 * z, 8 * w * math.exp(-32 * z * z) / math.sqrt(2 * math.pi), 0.5 * math.erfc(-8 * z / math.sqrt(2))) for z, w in native.legendre(native.NODES)])}),
    sn(s, w) AS (VALUES {_values(native.legendre(native.SPREAD_NODES))}), half(u, h) AS (VALUES {_values([((u + 1) / 2, h / 2) for u, h in native.legendre(40)])}),
    lim AS (SELECT *, greatest(1e-6, 1 - 8 / sqrt(2 * df)) AS lo, 1 + 8 / sqrt(2 * df) AS hi FROM t WHERE q IS NOT NULL),
    sp AS (SELECT feature, g1, g2, q, df, (s + 1) / 2 * (hi - lo) + lo AS s, w * (hi - lo) / 2 AS w FROM lim, sn),
    xs AS (SELECT sp.*, zn.w AS wz, zn.p AS pz, least(9, greatest(-9, zn.z - q * s)) AS x FROM sp, zn),
    ph AS (SELECT feature, g1, g2, df, s, w, wz, pz, 0.5 + any_value(x) * sum(h * exp(-x * x * u * u / 2)) / sqrt(2 * pi()) AS below FROM xs, half GROUP BY feature, g1, g2, df, s, w, wz, pz, x),
    rc AS (SELECT feature, g1, g2, df, s, w, least(1, 3 * sum(wz * pow(greatest(pz - below, 0), 2))) AS r FROM ph GROUP BY feature, g1, g2, df, s, w),
    tail AS (SELECT feature, g1, g2, greatest(0, least(1, 1 - sum(w * exp(ln(2) + df / 2 * ln(df / 2) - lgamma(df / 2) + (df - 1) * ln(s) - df * s * s / 2) * r))) AS p FROM rc GROUP BY feature, g1, g2)"""


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


EMB = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS j FROM embeddings),
    ce AS (SELECT label, j, avg(x) AS c FROM v GROUP BY ALL), gr AS (SELECT j, avg(x) AS g FROM v GROUP BY j),
    sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)"""


def _bh(spark: SparkSession, d: str) -> DataFrame:
    p = stats.anova(long(spark, d), "treatment").select("feature", F.round("p_value", 6).alias("p_value"))
    return rounded(stats.benjamini_hochberg(p, [], "p_value", "feature"))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).withColumn("vehicle", F.col("treatment") == "VEH")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    """A labelling of all flies: channel modulo five, the first of which is noise."""
    return _kept(spark, d).select("fly_id", (F.col("channel") % 5 - 1).alias("cluster_hdbscan"))


def _ari(spark: SparkSession, d: str) -> DataFrame:
    flies = _kept(spark, d)
    return rounded(cluster.agreement(flies, "genotype", "treatment"), 6)


QUERIES = {
    "win22_mid_ranks": (lambda s, d: rounded(stats.mid_ranks(long(s, d), ["feature"]).select("fly_id", "feature", "mid_rank")), f"WITH {RANKS} SELECT fly_id, feature, mid_rank FROM rk"),
    "sta8_anova": (lambda s, d: rounded(stats.anova(long(s, d), "treatment")), f"WITH {ANOVA} SELECT feature, k, n, round(f, 4) AS f, round(p_value, 4) AS p_value, round(eta_squared, 4) AS eta_squared FROM anova"),
    "sta9_kruskal": (lambda s, d: rounded(stats.kruskal(long(s, d), "treatment")), f"WITH {KRUSKAL} SELECT feature, k, n::BIGINT AS n, round(h, 4) AS h, round(exp(-h / 2), 4) AS p_value, round(greatest(0, (h - k + 1) / (n - k)), 4) AS epsilon_squared FROM h"),
    "sta12_dunn": (lambda s, d: rounded(stats.dunn(long(s, d), "treatment").select("feature", "g1", "g2", "z")), f"WITH {RANKS}, g AS (SELECT feature, treatment, count(*)::DOUBLE AS n, avg(mid_rank) AS r, sum(ties * ties - 1)::DOUBLE AS t FROM rk GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(t) OVER (PARTITION BY feature) AS tt FROM g) SELECT a.feature, a.treatment AS g1, b.treatment AS g2, round((a.r - b.r) / sqrt((a.nn * (a.nn + 1) / 12 - a.tt / (12 * (a.nn - 1))) * (1 / a.n + 1 / b.n)), 4) AS z FROM w a JOIN w b ON a.feature = b.feature AND a.treatment < b.treatment"),
    "sta12_dunn_p": (lambda s, d: rounded(stats.dunn(long(s, d), "treatment")), f"WITH {RANKS}, g AS (SELECT feature, treatment, count(*)::DOUBLE AS n, avg(mid_rank) AS r, sum(ties * ties - 1)::DOUBLE AS t FROM rk GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(t) OVER (PARTITION BY feature) AS tt, count(*) OVER (PARTITION BY feature) AS k FROM g), z AS (SELECT a.feature, a.treatment AS g1, b.treatment AS g2, a.k, (a.r - b.r) / nullif(sqrt((a.nn * (a.nn + 1) / 12 - a.tt / (12 * (a.nn - 1))) * (1 / a.n + 1 / b.n)), 0) AS z FROM w a JOIN w b ON a.feature = b.feature AND a.treatment < b.treatment) SELECT feature, g1, g2, round(z, 4) AS z, round(least(1, {_normal_p('z')} * k * (k - 1) / 2), 4) AS p_adj FROM z"),
    "sta11_tukey": (lambda s, d: rounded(stats.tukey(long(s, d), "treatment").select("feature", "g1", "g2", "q"), 3), f"WITH {LONG}, g AS (SELECT feature, treatment, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM lng GROUP BY ALL), w AS (SELECT *, sum(n * v) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature) - count(*) OVER (PARTITION BY feature)) AS mse FROM g) SELECT a.feature, a.treatment AS g1, b.treatment AS g2, round(abs(a.m - b.m) / nullif(sqrt(a.mse / 2 * (1 / a.n + 1 / b.n)), 0), 3) AS q FROM w a JOIN w b ON a.feature = b.feature AND a.treatment < b.treatment"),
    "sta11_tukey_p": (lambda s, d: rounded(stats.tukey(long(s, d), "treatment").select("feature", "g1", "g2", "p_adj"), 5), f"WITH {LONG}, g AS (SELECT feature, treatment, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM lng GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY feature) - count(*) OVER (PARTITION BY feature) AS df, sum(n * v) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature) - count(*) OVER (PARTITION BY feature)) AS mse FROM g), t AS (SELECT a.feature, a.treatment AS g1, b.treatment AS g2, a.df::DOUBLE AS df, abs(a.m - b.m) / nullif(sqrt(a.mse / 2 * (1 / a.n + 1 / b.n)), 0) AS q FROM w a JOIN w b ON a.feature = b.feature AND a.treatment < b.treatment){TUKEY_TAIL} SELECT feature, g1, g2, round(tail.p, 5) AS p_adj FROM t LEFT JOIN tail USING (feature, g1, g2)"),
    "sta14_mann_whitney_p": (lambda s, d: rounded(stats.mann_whitney(long(s, d), ["feature"], F.lower("sex").startswith("f"), exact=False).select("feature", "p_value"), 5), f"WITH {RANKS}, g AS (SELECT feature, count(*) FILTER (sex = 'Female')::DOUBLE AS n1, count(*) FILTER (sex <> 'Female')::DOUBLE AS n2, sum(mid_rank) FILTER (sex = 'Female') AS r1, sum(ties * ties - 1)::DOUBLE AS t FROM rk GROUP BY feature HAVING n1 >= 3 AND n2 >= 3), z AS (SELECT feature, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM g) SELECT feature, round(coalesce({_normal_p('z')}, 1), 5) AS p_value FROM z"),
    "join20_one_vs_rest_p": (lambda s, d: rounded(stats.one_vs_rest(long(s, d), "genotype").select("feature", "genotype", "p_value"), 5), f"WITH {RANKS}, g AS (SELECT feature, genotype, count(*)::DOUBLE AS n1, sum(mid_rank) AS r1, sum(ties * ties - 1)::DOUBLE AS t FROM rk GROUP BY ALL), w AS (SELECT feature, genotype, n1, r1, sum(n1) OVER f - n1 AS n2, sum(n1) OVER f AS n, sum(t) OVER f AS t FROM g WINDOW f AS (PARTITION BY feature)), z AS (SELECT feature, genotype, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))), 0) AS z FROM w WHERE n1 >= 3 AND n2 >= 3) SELECT feature, genotype, round(coalesce({_normal_p('z')}, 1), 5) AS p_value FROM z"),
    "sta7_normality": (lambda s, d: rounded(stats.normality(long(s, d), "treatment")), None),
    "sta10_compare_groups": (lambda s, d: rounded(stats.compare_groups(long(s, d), "treatment")), None),
    "win19_benjamini_hochberg": (_bh, f"WITH {ANOVA}, p AS (SELECT feature, round(p_value, 6) AS p_value FROM anova), q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, feature) AS q FROM p) SELECT feature, round(p_value, 4) AS p_value, round(least(1, min(q) OVER (ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)), 4) AS p_adj FROM q"),
    "sta14_mann_whitney": (lambda s, d: rounded(stats.mann_whitney(long(s, d), ["feature"], F.lower("sex").startswith("f")).select("feature", "n1", "n2", "u", "rank_biserial")), f"WITH {RANKS} SELECT feature, count(*) FILTER (sex = 'Female') AS n1, count(*) FILTER (sex <> 'Female') AS n2, round(sum(mid_rank) FILTER (sex = 'Female') - n1 * (n1 + 1) / 2.0, 4) AS u, round(2 * (sum(mid_rank) FILTER (sex = 'Female') - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 4) AS rank_biserial FROM rk GROUP BY feature HAVING n1 >= 3 AND n2 >= 3"),
    "join20_one_vs_rest": (lambda s, d: rounded(stats.one_vs_rest(long(s, d), "genotype").select("feature", "genotype", "u", "rank_biserial", "direction")), f"WITH {RANKS}, g AS (SELECT feature, genotype, count(*) AS n1, sum(mid_rank) AS r1 FROM rk GROUP BY ALL), w AS (SELECT *, sum(n1) OVER (PARTITION BY feature) - n1 AS n2, r1 - n1 * (n1 + 1) / 2.0 AS u FROM g) SELECT feature, genotype, round(u, 4) AS u, round(2 * u / (n1 * n2)::DOUBLE - 1, 4) AS rank_biserial, CASE WHEN 2 * u / (n1 * n2)::DOUBLE - 1 > 0 THEN 'elevated' ELSE 'suppressed' END AS direction FROM w WHERE n1 >= 3 AND n2 >= 3"),
    "sta15_chi_square": (lambda s, d: rounded(stats.chi_square(_kept(s, d), "genotype", "treatment").select("chi2", "df")), f"WITH {GOOD}, n AS (SELECT genotype, treatment, count(*) AS n FROM kept GROUP BY ALL), a AS (SELECT genotype, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT treatment, sum(n) AS b FROM n GROUP BY 1), e AS (SELECT genotype, treatment, a * b / (SELECT sum(n) FROM n)::DOUBLE AS e FROM a, b) SELECT round(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e), 4) AS chi2, ((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS df FROM e LEFT JOIN n USING (genotype, treatment)"),
    "sta15_fisher": (lambda s, d: rounded(stats.fisher(_halves(s, d), "sex", "vehicle"), 6), f"WITH {GOOD}, c AS (SELECT sex, treatment = 'VEH' AS vehicle, count(*) AS n FROM kept GROUP BY ALL), g AS (SELECT s.sex, v.vehicle, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT sex FROM c) s CROSS JOIN (SELECT DISTINCT vehicle FROM c) v LEFT JOIN c ON c.sex = s.sex AND c.vehicle = v.vehicle), q AS (SELECT list(n ORDER BY sex, vehicle) AS l FROM g), m AS (SELECT l[1]::BIGINT AS a, (l[1] + l[2])::BIGINT AS r, (l[1] + l[3])::BIGINT AS k, (l[1] + l[2] + l[3] + l[4])::BIGINT AS n FROM q), p AS (SELECT x, a, lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(r - x + 1) - lgamma(n - k - r + x + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) AS lp FROM (SELECT *, unnest(generate_series(greatest(0, r + k - n), least(r, k))) AS x FROM m)) SELECT 'Fisher exact' AS test, round(least(1, sum(exp(lp))), 6) AS p_value FROM p WHERE exp(lp) <= (SELECT exp(lp) FROM p WHERE x = a) * (1 + 1e-7) HAVING count(*) > 0"),
    "sta15_composition": (lambda s, d: rounded(stats.composition(_kept(s, d), "genotype", "treatment")), None),
    "join14_clusters_features": (lambda s, d: rounded(cluster.with_clusters(_kept(s, d), _clusters(s, d)).groupBy("cluster", "genotype").agg(F.count(F.lit(1)).alias("n"), F.avg("total_sleep_mean").alias("sleep"))), f"WITH {GOOD} SELECT channel::BIGINT % 5 - 1 AS cluster, genotype, count(*) AS n, round(avg(total_sleep_mean), 4) AS sleep FROM kept WHERE channel % 5 > 0 GROUP BY ALL"),
    "prj12_display_names": (lambda s, d: rounded(files.display_names(stats.medians(long(s, d), "sex"))), f"WITH {LONG} SELECT sex, CASE feature {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())} ELSE feature END AS feature, round(median(value), 4) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, count(*) AS n FROM lng GROUP BY ALL"),
    "agg16_contingency": (lambda s, d: rounded(stats.contingency(_kept(s, d), "genotype", "sex")), f"WITH {GOOD}, n AS (SELECT genotype, sex, count(*) AS n FROM kept GROUP BY ALL), a AS (SELECT genotype, sum(n) AS a FROM n GROUP BY 1), b AS (SELECT sex, sum(n) AS b FROM n GROUP BY 1) SELECT genotype, sex, coalesce(n, 0)::BIGINT AS n, round(a * b / (SELECT sum(n) FROM n)::DOUBLE, 4) AS expected, round(coalesce(n, 0) * 100 / a::DOUBLE, 4) AS row_percent FROM a CROSS JOIN b LEFT JOIN n USING (genotype, sex)"),
    "sta16_cliffs_delta": (lambda s, d: rounded(stats.cliffs_delta(long(s, d), "genotype")), f"WITH {LONG} SELECT x.feature, x.genotype AS g1, y.genotype AS g2, round(avg(sign(x.value - y.value)), 4) AS delta, CASE WHEN abs(avg(sign(x.value - y.value))) < 0.147 THEN 'negligible' WHEN abs(avg(sign(x.value - y.value))) < 0.33 THEN 'small' WHEN abs(avg(sign(x.value - y.value))) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM lng x JOIN lng y ON x.feature = y.feature AND x.genotype < y.genotype GROUP BY ALL"),
    "sta17_cohens_d": (lambda s, d: rounded(stats.cohens_d(long(s, d), "genotype")), f"WITH {LONG}, g AS (SELECT DISTINCT genotype FROM lng), m AS (SELECT l.feature, g.genotype, count(*) FILTER (l.genotype = g.genotype) AS n1, count(*) FILTER (l.genotype <> g.genotype) AS n2, avg(value) FILTER (l.genotype = g.genotype) AS m1, avg(value) FILTER (l.genotype <> g.genotype) AS m2, var_samp(value) FILTER (l.genotype = g.genotype) AS v1, var_samp(value) FILTER (l.genotype <> g.genotype) AS v2 FROM lng l, g GROUP BY ALL) SELECT feature, genotype, round(CASE WHEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) < 1e-12 THEN 0 ELSE (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END, 4) AS d FROM m WHERE n1 >= 2 AND n2 >= 2"),
    "agg17_group_medians": (lambda s, d: rounded(stats.medians(long(s, d), "genotype")), f"WITH {LONG} SELECT genotype, feature, round(median(value), 4) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, count(*) AS n FROM lng GROUP BY ALL"),
    "agg18_signature": (lambda s, d: rounded(_kept(s, d).groupBy("genotype").agg(*[F.avg(c).alias(c) for c in ALL_NAMES]), 7), f"WITH {GOOD} SELECT genotype, {', '.join(f'round(avg({c}), 7) AS {c}' for c in ALL_NAMES)} FROM kept GROUP BY genotype"),
    "srt4_top_effects": (lambda s, d: rounded(cluster.top_k(stats.cohens_d(long(s, d), "genotype"), ["genotype"], F.abs(F.round("d", 6)), 5, "feature")), f"WITH {LONG}, g AS (SELECT DISTINCT genotype FROM lng), m AS (SELECT l.feature, g.genotype, count(*) FILTER (l.genotype = g.genotype) AS n1, count(*) FILTER (l.genotype <> g.genotype) AS n2, avg(value) FILTER (l.genotype = g.genotype) AS m1, avg(value) FILTER (l.genotype <> g.genotype) AS m2, var_samp(value) FILTER (l.genotype = g.genotype) AS v1, var_samp(value) FILTER (l.genotype <> g.genotype) AS v2 FROM lng l, g GROUP BY ALL), ds AS (SELECT feature, genotype, CASE WHEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) < 1e-12 THEN 0 ELSE (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END AS d FROM m WHERE n1 >= 2 AND n2 >= 2) SELECT genotype, feature, round(d, 4) AS d, row_number() OVER (PARTITION BY genotype ORDER BY abs(round(d, 6)) DESC, feature) AS rank FROM ds QUALIFY rank <= 5"),
    "sta18_davies_calinski": (lambda s, d: rounded(cluster.centroid_scores(cluster.components_long(embedded(s, d), "vec_id", "label", "embedding")), 4), f"WITH {EMB}, w AS (SELECT label, vec_id, sqrt(sum((x - c) * (x - c))) AS dist, sum((x - c) * (x - c)) AS sq FROM v JOIN ce USING (label, j) GROUP BY ALL), s AS (SELECT label, avg(dist) AS s, sum(sq) AS ssw FROM w GROUP BY label), m AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM ce a JOIN ce b ON a.j = b.j AND a.label <> b.label GROUP BY ALL), r AS (SELECT la, max((x.s + y.s) / m) AS r FROM m JOIN s x ON la = x.label JOIN s y ON lb = y.label GROUP BY la), bs AS (SELECT sum(n * (c - g) * (c - g)) AS ssb FROM ce JOIN gr USING (j) JOIN sz USING (label)) SELECT (SELECT count(*) FROM sz) AS n_clusters, round((SELECT avg(r) FROM r), 4) AS davies_bouldin, round((SELECT ssb FROM bs) / ((SELECT count(*) FROM sz) - 1) / ((SELECT sum(ssw) FROM s) / ((SELECT sum(n) FROM sz) - (SELECT count(*) FROM sz))), 4) AS calinski_harabasz"),
    "sta18_silhouette": (lambda s, d: rounded(cluster.silhouette(embedded(s, d), "vec_id", "label", "embedding"), 4), "WITH p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL), x AS (SELECT vec_id, la, max(s / n) FILTER (la = lb) AS a, min(s / n) FILTER (la <> lb) AS b FROM p GROUP BY ALL) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM x"),
    "sta19_agreement": (_ari, f"WITH {GOOD}, c AS (SELECT genotype, treatment, count(*)::DOUBLE AS n FROM kept GROUP BY ALL), a AS (SELECT genotype, sum(n) AS a FROM c GROUP BY 1), b AS (SELECT treatment, sum(n) AS b FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c), e AS (SELECT coalesce(sum(x.e), 0) AS emi FROM (SELECT (k / t.t) * ln(t.t * k / (a.a * b.b)) * exp(lgamma(a.a + 1) + lgamma(b.b + 1) + lgamma(t.t - a.a + 1) + lgamma(t.t - b.b + 1) - lgamma(t.t + 1) - lgamma(k + 1) - lgamma(a.a - k + 1) - lgamma(b.b - k + 1) - lgamma(t.t - a.a - b.b + k + 1)) AS e FROM a, b, t, LATERAL (SELECT unnest(generate_series(greatest(1, a.a + b.b - t.t)::BIGINT, least(a.a, b.b)::BIGINT))::DOUBLE AS k)) x), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(a * (a - 1) / 2) FROM a) AS ai, (SELECT sum(b * (b - 1) / 2) FROM b) AS bj, (SELECT t * (t - 1) / 2 FROM t) AS tt, (SELECT sum(n / t * ln(n * t / (a * b))) FROM c JOIN a USING (genotype) JOIN b USING (treatment), t) AS mi, (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hb, (SELECT emi FROM e) AS emi) SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami, round((ij - ai * bj / tt) / ((ai + bj) / 2 - ai * bj / tt), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM s"),
    "ml3_nearest_neighbours": (lambda s, d: rounded(cluster.knn(embedded(s, d), "vec_id", "embedding", 5), 4), "SELECT vec_id, k, round(distance, 4) AS distance FROM (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) - 1 AS k FROM embeddings a, embeddings b) WHERE k < 5"),
}
