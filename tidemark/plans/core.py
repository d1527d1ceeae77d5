"""Queries of the pipeline from readings to z-scores, and the same in DuckDB's SQL.

Bins are hours here; a sleep bout needs three of them. Every value that isn't a count is rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, health, rhythm, sleep
from tidemark.operators.runs import run_lengths
from tidemark.schemas import FLY, THRESHOLDS
from tidemark.sources import adapter

BIN, THRESHOLD = 60, 180


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, counts as long, dates and times as text."""
    cast = {
        "double": lambda c: F.round(F.col(c), digits), "int": lambda c: F.col(c).cast("long"), "date": lambda c: F.col(c).cast("string"),
        "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    }
    return df.select(*[cast[t](c).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.hourly_totals(adapter.dense(spark, d))


def table(spark: SparkSession, d: str, with_periodogram: bool = False) -> DataFrame:
    """The feature table; queries that use none of the periodogram's columns leave it out."""
    return features.feature_table(adapter.dense(spark, d), BIN, THRESHOLD, with_periodogram=with_periodogram)


#: Users of the event table that make one fly where status counts: some nine events a day. Thresholds fit that rate.
USERS, STATUS = 4, THRESHOLDS | {"A1": 11 * 60, "A2": 15 * 60, "activity_low": 5, "sleep_bout": 10 * 60}


def watched(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bins of flies of USERS users, missing where an error was read."""
    return adapter.dense(spark, d, users=USERS, missing=True)


def days(spark: SparkSession, d: str) -> DataFrame:
    return health.fly_days(watched(spark, d), BIN, t=STATUS)


def status(spark: SparkSession, d: str, **options) -> DataFrame:
    days = health.with_decline(health.daily_metrics(watched(spark, d), BIN))
    return rounded(health.with_status(days, BIN, t=STATUS, **options).select("fly_id", "exp_day", "status", "missing_frac"))


FLY_SQL = """
    'M' || (user_id // 32) || '_Ch' || lpad((user_id % 32 + 1)::VARCHAR, 2, '0') AS fly_id, (user_id // 32)::VARCHAR AS monitor,
    (user_id % 32 + 1)::INTEGER AS channel, ['Iso', 'Fmn', 'Rye', 'SSS'][(user_id % 4 + 1)::INTEGER] AS genotype,
    ['Female', 'Male'][((user_id // 4) % 2 + 1)::INTEGER] AS sex, ['VEH', '2mM Arg', '8mM Arg'][(user_id % 3 + 1)::INTEGER] AS treatment"""
TIME_SQL = """
    datetime::DATE AS date, floor((hour(datetime) + minute(datetime) / 60.0 - 9 + 24) % 24)::INTEGER AS zt,
    (datediff('day', DATE '2024-01-01', datetime::DATE) + 1)::INTEGER AS exp_day"""


def dense_sql(users: int = 1, missing: bool = False) -> str:
    n = "CASE WHEN NOT bool_or(event_type = 'error') THEN count(*) END" if missing else "count(*)"
    return f"""
    raw AS (SELECT user_id // {users} AS user_id, time_bucket(INTERVAL 1 HOUR, ts) AS datetime, {n} AS n, sum(value) AS value, true AS seen FROM events GROUP BY 1, 2),
    grid AS (SELECT u.user_id, g.datetime FROM (SELECT DISTINCT user_id // {users} AS user_id FROM events) u,
             (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS datetime) g),
    dense AS (SELECT {FLY_SQL}, datetime, CASE WHEN seen THEN n ELSE 0 END AS n, coalesce(value, 0) AS value, {TIME_SQL}
              FROM grid LEFT JOIN raw USING (user_id, datetime))"""


DENSE = dense_sql()
HOURLY = DENSE + """,
    used AS (SELECT * FROM dense),
    hourly AS (SELECT fly_id, monitor, channel, genotype, sex, treatment, exp_day, zt, sum(value) AS y FROM used GROUP BY ALL)"""
USED_DAYS = HOURLY.replace("FROM dense),", "FROM dense WHERE exp_day NOT IN (1, 7)),")
D = "fly_id, monitor, channel, genotype, sex, treatment, exp_day"
FL = "fly_id, monitor, channel, genotype, sex, treatment"
COSINOR = f""",
    cs AS (SELECT *, cos(2 * pi() * zt / 24.0) AS c, sin(2 * pi() * zt / 24.0) AS s FROM hourly),
    sums AS (SELECT {D}, count(*) AS n, sum(y) AS y1, sum(c) AS c1, sum(s) AS s1, sum(c * c) - sum(c) * sum(c) / count(*) AS cc,
                    sum(s * s) - sum(s) * sum(s) / count(*) AS ss, sum(c * s) - sum(c) * sum(s) / count(*) AS sc,
                    sum(y * c) - sum(y) * sum(c) / count(*) AS yc, sum(y * s) - sum(y) * sum(s) / count(*) AS ys,
                    sum(y * y) - sum(y) * sum(y) / count(*) AS sst FROM cs GROUP BY {D}),
    ab AS (SELECT *, (yc * ss - ys * sc) / (cc * ss - sc * sc) AS a, (ys * cc - yc * sc) / (cc * ss - sc * sc) AS b FROM sums),
    fit AS (SELECT *, greatest(sst - a * yc - b * ys, 0) AS sse FROM ab),
    cosinor AS (SELECT {D}, (y1 - a * c1 - b * s1) / n AS mesor, sqrt(a * a + b * b) AS amplitude,
                       CASE WHEN sqrt(a * a + b * b) < 1e-9 THEN 0 ELSE (round(24 * atan2(-b, a) / (2 * pi()), 9) % 24 + 24) % 24 END AS phase,
                       CASE WHEN n <= 3 OR sst <= 1e-9 THEN NULL WHEN sse <= 1e-12 * sst THEN 0
                            ELSE pow(1 + 2 * (((sst - sse) / 2) / (sse / (n - 3))) / (n - 3), -(n - 3) / 2.0) END AS p_value FROM fit)"""
ONSET = f""",
    sm AS (SELECT *, avg(y) OVER (PARTITION BY {D} ORDER BY zt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth,
                  row_number() OVER (PARTITION BY {D} ORDER BY zt) AS i FROM hourly),
    thr AS (SELECT {D}, quantile_cont(smooth, 0.1) + stddev_pop(smooth) AS threshold, min({{'v': round(smooth, 9), 'i': i}}) AS low FROM sm GROUP BY {D}),
    ab0 AS (SELECT sm.*, low.i AS low_i, round(smooth - threshold, 9) > 0 AS above FROM sm JOIN thr USING ({D})),
    ab1 AS (SELECT *, lead(above, 1) OVER w AS n1, lead(above, 2) OVER w AS n2 FROM ab0 WINDOW w AS (PARTITION BY {D} ORDER BY zt)),
    onset AS (SELECT {D}, min(CASE WHEN i >= low_i AND above AND n1 THEN zt END) AS onset_zt,
                     max(CASE WHEN above AND NOT n1 AND NOT n2 THEN zt END) AS offset_zt FROM ab1 GROUP BY {D})"""
STABILITY = f""",
    hm AS (SELECT {FL}, zt, avg(y) AS m FROM hourly GROUP BY ALL), gm AS (SELECT {FL}, avg(y) AS g, count(*) AS n FROM hourly GROUP BY ALL),
    tot AS (SELECT {FL}, sum((y - g) * (y - g)) AS t FROM hourly JOIN gm USING ({FL}) GROUP BY ALL),
    stab AS (SELECT {FL}, CASE WHEN any_value(n) >= 2 AND any_value(t) > 1e-9 THEN any_value(n) * sum((m - g) * (m - g)) / (count(*) * any_value(t)) END AS interdaily_stability
             FROM hm JOIN gm USING ({FL}) JOIN tot USING ({FL}) GROUP BY {FL})"""
RHYTHM = COSINOR + ONSET + STABILITY + f""",
    rhythm AS (SELECT {FL}, avg(mesor) AS mesor_mean, stddev_samp(mesor) AS mesor_sd, avg(amplitude) AS amplitude_mean, stddev_samp(amplitude) AS amplitude_sd,
                      avg(phase) AS phase_mean, stddev_samp(phase) AS phase_sd, count(*) FILTER (p_value < 0.05) AS rhythmic_days,
                      avg(onset_zt) AS activity_onset_zt_mean, stddev_samp(onset_zt) AS activity_onset_zt_sd,
                      avg(offset_zt) AS activity_offset_zt_mean, stddev_samp(offset_zt) AS activity_offset_zt_sd,
                      any_value(interdaily_stability) AS interdaily_stability
               FROM cosinor JOIN onset USING ({D}) JOIN stab USING ({FL}) GROUP BY {FL})"""
PERIODOGRAM = """,
    fr AS (SELECT i, 2 * pi() / (18.0::DOUBLE + 12.0::DOUBLE * i / 999.0::DOUBLE) AS w FROM range(1000) t(i)),
    zs AS (SELECT DISTINCT zt, 2 * pi() * zt / 24.0 AS t FROM hourly),
    ta AS (SELECT i, w, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / 2 AS tau FROM fr, zs GROUP BY ALL),
    ba AS (SELECT i, zt, cos(w * t - tau) AS c, sin(w * t - tau) AS s FROM ta, zs),
    bl AS (SELECT i, list(c ORDER BY zt) AS cs, list(s ORDER BY zt) AS ss, sum(c * c) AS cn, sum(s * s) AS sn FROM ba GROUP BY i),
    yd AS (SELECT fly_id, exp_day, zt, y - avg(y) OVER (PARTITION BY fly_id, exp_day) AS y FROM hourly),
    yl AS (SELECT fly_id, exp_day, list(y ORDER BY zt) AS ys, sum(y * y) AS yy FROM yd GROUP BY ALL HAVING sum(y * y) > 0),
    pm AS (SELECT fly_id, exp_day, max({'p': (pow(list_dot_product(ys, cs), 2) / cn + pow(list_dot_product(ys, ss), 2) / sn) / yy, 'i': -i}) AS m FROM yl, bl GROUP BY ALL),
    pg AS (SELECT fly_id, exp_day, 18.0::DOUBLE - 12.0::DOUBLE * m.i / 999.0::DOUBLE AS periodogram_period, m.p AS periodogram_power FROM pm),
    pf AS (SELECT fly_id, avg(periodogram_period) AS periodogram_period_mean, stddev_samp(periodogram_period) AS periodogram_period_sd, avg(periodogram_power) AS periodogram_power_mean FROM pg GROUP BY fly_id)"""
PERIOD_NAMES = ["periodogram_period_mean", "periodogram_period_sd", "periodogram_power_mean"]
RUNS = """,
    fl AS (SELECT *, n = 0 AS zero FROM used),
    ch AS (SELECT *, CASE WHEN lag(zero) OVER w IS DISTINCT FROM zero THEN 1 ELSE 0 END AS opens FROM fl WINDOW w AS (PARTITION BY fly_id, exp_day ORDER BY datetime)),
    rn AS (SELECT *, sum(opens) OVER (PARTITION BY fly_id, exp_day ORDER BY datetime) AS run_id FROM ch)"""
SLEEP = RUNS + f""",
    sl AS (SELECT *, zero AND count(*) OVER (PARTITION BY fly_id, exp_day, run_id) * 60 >= 180 AS sleep, zt < 12 AS is_day FROM rn),
    sb AS (SELECT *, lag(sleep) OVER w AS before, row_number() OVER w AS i FROM sl WINDOW w AS (PARTITION BY fly_id, exp_day ORDER BY datetime)),
    bouts AS (SELECT {D}, run_id, min(datetime) AS start, count(*) * 60 AS minutes, min_by(is_day, datetime) AS is_day FROM sb WHERE sleep GROUP BY {D}, run_id),
    bstat AS (SELECT {D}, count(*) AS total_bouts, count(*) FILTER (is_day) AS day_bouts, count(*) FILTER (NOT is_day) AS night_bouts, avg(minutes) AS mean_bout,
                     max(minutes) AS max_bout, avg(minutes) FILTER (is_day) AS mean_day_bout, max(minutes) FILTER (is_day) AS max_day_bout,
                     avg(minutes) FILTER (NOT is_day) AS mean_night_bout, max(minutes) FILTER (NOT is_day) AS max_night_bout FROM bouts GROUP BY {D}),
    dk AS (SELECT {D}, sleep, row_number() OVER (PARTITION BY fly_id, exp_day ORDER BY datetime) - 1 AS k FROM sb WHERE zt >= 12),
    dk1 AS (SELECT {D}, min(k) FILTER (sleep) AS first FROM dk GROUP BY {D}),
    dk2 AS (SELECT {D}, any_value(first) * 60 AS sleep_latency, CASE WHEN any_value(first) IS NOT NULL THEN 60 * count(*) FILTER (NOT sleep AND k >= first) END AS waso
            FROM dk JOIN dk1 USING ({D}) GROUP BY {D}),
    bins AS (SELECT {D}, count(*) FILTER (sleep) AS ns, count(*) FILTER (NOT sleep) AS nw, count(*) AS nn, count(*) FILTER (sleep AND is_day) AS nd,
                    count(*) FILTER (NOT sleep AND before) AS wakes, count(*) FILTER (sleep AND NOT before) AS dozes,
                    count(*) FILTER (NOT sleep AND coalesce(before, true)) AS wake_bouts FROM sb GROUP BY {D}),
    daily AS (SELECT {D}, ns * 60.0 AS total_sleep, nd * 60.0 AS day_sleep, (ns - nd) * 60.0 AS night_sleep, coalesce(total_bouts, 0) AS total_bouts,
                     coalesce(day_bouts, 0) AS day_bouts, coalesce(night_bouts, 0) AS night_bouts, mean_bout, max_bout::DOUBLE AS max_bout, mean_day_bout,
                     max_day_bout::DOUBLE AS max_day_bout, mean_night_bout, max_night_bout::DOUBLE AS max_night_bout,
                     coalesce(total_bouts, 0) / (nn::DOUBLE) AS frag_bouts_per_hour, coalesce(total_bouts, 0) / nullif(ns * 60.0, 0) AS frag_bouts_per_min_sleep,
                     nw * 60.0 / nullif(wake_bouts, 0) AS mean_wake_bout, wakes / nullif(ns, 0)::DOUBLE AS p_wake, dozes / nullif(nw, 0)::DOUBLE AS p_doze,
                     sleep_latency::DOUBLE AS sleep_latency, waso::DOUBLE AS waso
              FROM bins LEFT JOIN bstat USING ({D}) LEFT JOIN dk2 USING ({D}))"""
SLEEP_NAMES = ["total_sleep", "day_sleep", "night_sleep", "total_bouts", "day_bouts", "night_bouts", "mean_bout", "max_bout", "mean_day_bout", "max_day_bout", "mean_night_bout", "max_night_bout", "frag_bouts_per_hour", "frag_bouts_per_min_sleep", "mean_wake_bout", "p_wake", "p_doze", "sleep_latency", "waso"]
SLEEP_MEANS = ", ".join(f"avg({c}) AS {c}_mean" for c in SLEEP_NAMES)
RHYTHM_NAMES = ["mesor_mean", "mesor_sd", "amplitude_mean", "amplitude_sd", "phase_mean", "phase_sd", "activity_onset_zt_mean", "activity_onset_zt_sd", "activity_offset_zt_mean", "activity_offset_zt_sd", "interdaily_stability"]
ALL_NAMES = [*RHYTHM_NAMES, *[f"{c}_mean" for c in SLEEP_NAMES]]
FEATURES = USED_DAYS + RHYTHM + SLEEP + f""",
    sfeat AS (SELECT {FL}, {SLEEP_MEANS}, count(*) AS n_days FROM daily GROUP BY {FL}),
    feat AS (SELECT * FROM rhythm JOIN sfeat USING ({FL}))"""
GOOD = FEATURES + """,
    kept AS (SELECT * FROM feat WHERE NOT (coalesce(total_sleep_mean, 0) = 0 OR coalesce(total_bouts_mean, 0) = 0)),
    bounds AS (SELECT genotype, sex, treatment, quantile_cont(total_sleep_mean, 0.25) AS q1, quantile_cont(total_sleep_mean, 0.75) AS q3 FROM kept GROUP BY ALL),
    flagged AS (SELECT kept.*, q1, q3, coalesce(total_sleep_mean < q1 - 1.5 * (q3 - q1) OR total_sleep_mean > q3 + 1.5 * (q3 - q1), false) AS is_outlier
                FROM kept LEFT JOIN bounds USING (genotype, sex, treatment)),
    clean AS (SELECT * EXCLUDE (q1, q3, is_outlier) REPLACE (coalesce(sleep_latency_mean, avg(sleep_latency_mean) OVER g) AS sleep_latency_mean,
                     coalesce(waso_mean, avg(waso_mean) OVER g) AS waso_mean, coalesce(mesor_sd, avg(mesor_sd) OVER g) AS mesor_sd,
                     coalesce(amplitude_sd, avg(amplitude_sd) OVER g) AS amplitude_sd, coalesce(phase_sd, avg(phase_sd) OVER g) AS phase_sd)
              FROM flagged WHERE NOT is_outlier WINDOW g AS (PARTITION BY genotype, sex, treatment))"""
HEALTH = dense_sql(USERS, True) + f""",
    used AS (SELECT *, abs(hour(datetime) - 9) <= 10 / 60.0 OR abs(hour(datetime) - 21) <= 10 / 60.0 AS edge FROM dense)""" + RUNS + f""",
    runs AS (SELECT {D}, date, run_id, zero, count(*) AS len, sum(n) AS total, count(*) FILTER (n > 0) AS active, count(*) FILTER (n IS NULL) AS missing, sum(CASE WHEN edge THEN n END) AS edge FROM rn GROUP BY ALL),
    dm AS (SELECT {D}, date, coalesce(sum(total), 0)::BIGINT AS total_activity, sum(active) / sum(len)::DOUBLE AS activity_index,
                  coalesce(max(CASE WHEN zero THEN len END), 0) * 60 AS longest_zero, coalesce(sum(CASE WHEN zero AND len >= 5 THEN len END), 0)::BIGINT * 60 AS total_sleep,
                  sum(missing) / sum(len)::DOUBLE AS missing_frac, coalesce(sum(edge), 0)::BIGINT AS transition_counts, coalesce(sum(edge), 0) = 0 AS no_startle FROM runs GROUP BY ALL),
    ref AS (SELECT *, max(CASE WHEN exp_day = 4 THEN total_activity END) OVER (PARTITION BY fly_id) AS ref_activity FROM dm),
    dec AS (SELECT *, total_activity / nullif(ref_activity, 0)::DOUBLE AS rel_activity FROM ref),
    dec2 AS (SELECT *, CASE WHEN ref_activity IS NULL THEN 'No Reference' WHEN rel_activity < 0.2 THEN 'Dead (by decline)'
                            WHEN rel_activity < 0.5 THEN 'Unhealthy (by decline)' ELSE 'Stable' END AS decline_status FROM dec),
    st AS (SELECT *, CASE WHEN longest_zero >= {STATUS["A2"]} OR (longest_zero >= {STATUS["A1"]} AND no_startle) THEN 'Dead'
                          WHEN (total_activity <= 5 OR activity_index <= 0.02 OR total_sleep >= 1300 OR longest_zero >= 600) AND no_startle THEN 'Unhealthy'
                          WHEN missing_frac > 0.1 THEN 'QC_Fail' ELSE 'Alive' END AS raw_status FROM dec2),
    fin AS (SELECT *, CASE WHEN max((raw_status = 'Dead')::INTEGER) OVER (PARTITION BY fly_id ORDER BY exp_day) = 1 THEN 'Dead' ELSE raw_status END AS status FROM st),
    report AS (SELECT {FL}, count(*) AS days_analyzed, count(*) FILTER (status = 'Alive') AS days_alive, count(*) FILTER (status = 'Unhealthy') AS days_unhealthy,
                      count(*) FILTER (status = 'Dead') AS days_dead, count(*) FILTER (status = 'QC_Fail') AS days_qc_fail,
                      min(exp_day) FILTER (status = 'Unhealthy') AS first_unhealthy_day, min(exp_day) FILTER (status = 'Dead') AS first_dead_day,
                      max(exp_day) FILTER (status = 'Alive') AS last_alive_day, max_by(status, exp_day) AS final_status FROM fin GROUP BY {FL})"""


def rnd(names: list[str], digits: int = 4) -> str:
    return ", ".join(f"round(({c})::DOUBLE, {digits}) AS {c}" for c in names)


#: Minutes of stillness that count as sleep where some flies are to have none.
LONG_SLEEP = 13 * 60
LONG = FEATURES.replace(DENSE, dense_sql(USERS)).replace(f">= {THRESHOLD}", f">= {LONG_SLEEP}")


def _problem(spark: SparkSession, d: str) -> DataFrame:
    bins = adapter.dense(spark, d, users=USERS)
    return features.problem_flies(features.feature_table(bins, BIN, LONG_SLEEP, with_periodogram=False)).select("fly_id", F.round("total_sleep_mean", 4).alias("total_sleep_mean"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d).where(~features.is_problem())


def _removal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    report = health.health_report(days(spark, d))
    return features.remove_flies(adapter.readings(spark, d, USERS), report, flies=["1-ch3"], days={"0-ch7": [1, 2]}, genotypes=["SSS"], treatments=["8mM Arg"], statuses=["Unhealthy"])


REMOVAL = HEALTH + f""",
    e AS (SELECT {FLY_SQL}, event_id, ts AS datetime, {TIME_SQL.replace("datetime", "ts")}, value FROM (SELECT * REPLACE (user_id // {USERS} AS user_id) FROM events)),
    tag AS (SELECT e.*, CASE WHEN lower(final_status) = 'unhealthy' THEN 'status' WHEN e.monitor || '-ch' || e.channel = '1-ch3' THEN 'fly'
                             WHEN e.monitor || '-ch' || e.channel = '0-ch7' AND exp_day IN (1, 2) THEN 'day' WHEN lower(e.genotype) = 'sss' THEN 'genotype'
                             WHEN lower(e.treatment) = '8mm arg' THEN 'treatment' END AS stage FROM e LEFT JOIN report r ON e.fly_id = r.fly_id)"""
STATS_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 4) AS {c}_z" for c in ALL_NAMES + PERIOD_NAMES)
REPORT_NAMES = "days_analyzed, days_alive, days_unhealthy, days_dead, days_qc_fail, first_unhealthy_day::BIGINT AS first_unhealthy_day, first_dead_day::BIGINT AS first_dead_day, last_alive_day::BIGINT AS last_alive_day, final_status"
CH = "fly_id, monitor, channel::BIGINT AS channel, genotype, sex, treatment"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adapter.readings(spark, d).select("event_id", "fly_id", "date", "zt", "phase", "exp_day", "reading_type"))


def _gaps(df: DataFrame) -> DataFrame:
    """The feature table with gaps: each feature is missing for the flies of every seventh channel, another one for each."""
    return df.withColumns({c: F.when((F.col("channel") + i) % 7 != 0, F.col(c)) for i, c in enumerate(ALL_NAMES)})


GAPS = ", gap AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN (channel + {i}) % 7 <> 0 THEN {c} END AS {c}" for i, c in enumerate(ALL_NAMES)) + ") FROM feat)"


def _missing(spark: SparkSession, d: str) -> DataFrame:
    return features.diagnostics(_gaps(table(spark, d, True)))



QUERIES = {
    "prj5_time_parts": (_parts, f"SELECT event_id, fly_id, date::VARCHAR AS date, zt::BIGINT AS zt, CASE WHEN zt < 12 THEN 'Light' ELSE 'Dark' END AS phase, exp_day::BIGINT AS exp_day, reading_type FROM (SELECT event_id, {FLY_SQL}, {TIME_SQL.replace('datetime', 'ts')}, CASE event_type WHEN 'view' THEN 'MT' WHEN 'click' THEN 'CT' ELSE 'Pn' END AS reading_type FROM events)"),
    "agg1_hourly_totals": (lambda s, d: rounded(hourly(s, d).select("fly_id", "exp_day", "zt", "hourly_mt")), f"WITH {HOURLY} SELECT fly_id, exp_day::BIGINT AS exp_day, zt::BIGINT AS zt, round(y, 4) AS hourly_mt FROM hourly"),
    "sta1_cosinor": (lambda s, d: rounded(rhythm.cosinor(hourly(s, d)).select("fly_id", "exp_day", "mesor", "amplitude", "phase", "p_value"), 6), f"WITH {HOURLY} {COSINOR} SELECT fly_id, exp_day::BIGINT AS exp_day, {rnd(['mesor', 'amplitude', 'phase', 'p_value'], 6)} FROM cosinor"),
    "sta3_onset_offset": (lambda s, d: rounded(rhythm.onset_offset(hourly(s, d)).select("fly_id", "exp_day", "onset_zt", "offset_zt")), f"WITH {HOURLY} {ONSET} SELECT fly_id, exp_day::BIGINT AS exp_day, onset_zt::BIGINT AS onset_zt, offset_zt::BIGINT AS offset_zt FROM onset"),
    "sta4_interdaily_stability": (lambda s, d: rounded(rhythm.interdaily_stability(hourly(s, d)).select("fly_id", "interdaily_stability"), 6), f"WITH {HOURLY} {STABILITY} SELECT fly_id, {rnd(['interdaily_stability'], 6)} FROM stab"),
    "agg6_rhythm_features": (lambda s, d: rounded(rhythm.rhythm_features(hourly(s, d)), 7), f"WITH {HOURLY} {RHYTHM} {PERIODOGRAM} SELECT {CH}, rhythmic_days, {rnd(RHYTHM_NAMES + PERIOD_NAMES, 7)} FROM rhythm LEFT JOIN pf USING (fly_id)"),
    "sta2_periodogram": (lambda s, d: rounded(rhythm.periodogram(hourly(s, d)).select("fly_id", "exp_day", "periodogram_period", "periodogram_power")), f"WITH {HOURLY} {PERIODOGRAM} SELECT fly_id, exp_day::BIGINT AS exp_day, round(periodogram_period, 4) AS periodogram_period, round(periodogram_power, 4) AS periodogram_power FROM (SELECT DISTINCT fly_id, exp_day FROM hourly) LEFT JOIN pg USING (fly_id, exp_day)"),
    "win1_run_lengths": (lambda s, d: rounded(run_lengths(adapter.dense(s, d), ["fly_id", "exp_day"], "datetime", F.col("n") == 0).withColumnRenamed("flag", "zero")), f"WITH {HOURLY} {RUNS} SELECT fly_id, exp_day::BIGINT AS exp_day, run_id::BIGINT AS run_id, zero, count(*) AS length, strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS start FROM rn GROUP BY fly_id, exp_day, run_id, zero"),
    "agg2_daily_metrics": (lambda s, d: rounded(health.daily_metrics(watched(s, d), BIN).select("fly_id", "date", "total_activity", "activity_index", "longest_zero", "total_sleep", "missing_frac")), f"WITH {HEALTH} SELECT fly_id, date::VARCHAR AS date, total_activity, round(activity_index, 4) AS activity_index, longest_zero, total_sleep, round(missing_frac, 4) AS missing_frac FROM dm"),
    "agg3_startle": (lambda s, d: rounded(health.daily_metrics(watched(s, d), BIN).select("fly_id", "date", "transition_counts", "no_startle")), f"WITH {HEALTH} SELECT fly_id, date::VARCHAR AS date, transition_counts, no_startle FROM dm"),
    "sta5_decline": (lambda s, d: rounded(days(s, d).select("fly_id", "exp_day", "ref_activity", "rel_activity", "decline_status")), f"WITH {HEALTH} SELECT fly_id, exp_day::BIGINT AS exp_day, ref_activity, round(rel_activity, 4) AS rel_activity, decline_status FROM dec2"),
    "sta6_status": (status, f"WITH {HEALTH} SELECT fly_id, exp_day::BIGINT AS exp_day, raw_status AS status, round(missing_frac, 4) AS missing_frac FROM st"),
    "sta6_status_a_in_bins": (lambda s, d: status(s, d, a_in_bins=True), f"WITH {HEALTH.replace(f'>= {STATUS["A2"]}', f'>= {STATUS["A2"] / BIN}').replace(f'>= {STATUS["A1"]}', f'>= {STATUS["A1"] / BIN}')} SELECT fly_id, exp_day::BIGINT AS exp_day, raw_status AS status, round(missing_frac, 4) AS missing_frac FROM st"),
    "sta6_status_with_decline": (lambda s, d: status(s, d, apply_decline=True), f"WITH {HEALTH} SELECT fly_id, exp_day::BIGINT AS exp_day, CASE WHEN raw_status = 'Dead' OR decline_status = 'Dead (by decline)' THEN 'Dead' WHEN raw_status = 'Unhealthy' OR decline_status = 'Unhealthy (by decline)' THEN 'Unhealthy' ELSE raw_status END AS status, round(missing_frac, 4) AS missing_frac FROM st"),
    "win10_irreversible_death": (lambda s, d: rounded(days(s, d).select("fly_id", "exp_day", "status")), f"WITH {HEALTH} SELECT fly_id, exp_day::BIGINT AS exp_day, status FROM fin"),
    "agg4_health_report": (lambda s, d: rounded(health.health_report(days(s, d))), f"WITH {HEALTH} SELECT {CH}, {REPORT_NAMES} FROM report"),
    "snk6_last_day_metrics": (lambda s, d: rounded(health.last_day_metrics(days(s, d))), f"WITH {HEALTH} SELECT fly_id, max_by(total_activity, exp_day) AS total_activity, round(least(max_by(longest_zero, exp_day) / 60.0, 999.99), 4) AS longest_zero_hours, round(greatest(least(max_by(rel_activity, exp_day), 99.999), -99.999), 4) AS rel_activity, NOT max_by(no_startle, exp_day) AS has_startle FROM fin GROUP BY fly_id"),
    "flt8_unusable_flies": (lambda s, d: rounded(health.without_usable_readings(adapter.readings(s, d).withColumn("value", F.greatest(F.col("value") - 100, F.lit(0.0))))), f"SELECT fly_id, monitor, channel::BIGINT AS channel, round(max(value) FILTER (event_type = 'view'), 4) AS max_mt, round(max(value) FILTER (event_type NOT IN ('view', 'click')), 4) AS max_pn FROM (SELECT {FLY_SQL}, greatest(value - 100, 0) AS value, event_type FROM events) GROUP BY ALL HAVING coalesce(max_mt, 0) <= 0 OR coalesce(max_pn, 0) <= 0"),
    "win5_sleep_bouts": (lambda s, d: rounded(sleep.sleep_bouts(adapter.dense(s, d), BIN, THRESHOLD).select("fly_id", "exp_day", "start", "minutes", "is_day")), f"WITH {HOURLY} {SLEEP} SELECT fly_id, exp_day::BIGINT AS exp_day, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, minutes, is_day FROM bouts"),
    "win6_sleep_daily": (lambda s, d: rounded(sleep.sleep_daily(adapter.dense(s, d), BIN, THRESHOLD).drop("monitor", "channel", "genotype", "sex", "treatment")), f"WITH {HOURLY} {SLEEP} SELECT fly_id, exp_day::BIGINT AS exp_day, total_bouts, day_bouts, night_bouts, {rnd([c for c in SLEEP_NAMES if c not in ('total_bouts', 'day_bouts', 'night_bouts')])} FROM daily"),
    "agg7_sleep_features": (lambda s, d: rounded(sleep.sleep_features(sleep.sleep_daily(adapter.dense(s, d), BIN, THRESHOLD)), 7), f"WITH {HOURLY} {SLEEP} SELECT {CH}, {', '.join(f'round(avg({c}), 7) AS {c}_mean' for c in SLEEP_NAMES)}, count(*) AS n_days FROM daily GROUP BY {FL}"),
    "join10_feature_table": (lambda s, d: rounded(table(s, d, True), 7), f"WITH {FEATURES} {PERIODOGRAM} SELECT {CH}, rhythmic_days, n_days, {rnd(ALL_NAMES + PERIOD_NAMES, 7)} FROM feat LEFT JOIN pf USING (fly_id)"),
    "flt9_problem_flies": (_problem, f"WITH {LONG} SELECT fly_id, round(total_sleep_mean, 4) AS total_sleep_mean FROM feat WHERE coalesce(total_sleep_mean, 0) = 0 OR coalesce(total_bouts_mean, 0) = 0"),
    "agg8_iqr_bounds": (lambda s, d: rounded(features.iqr_bounds(_kept(s, d))), f"WITH {GOOD} SELECT genotype, sex, treatment, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM bounds"),
    "flt10_iqr_outliers": (lambda s, d: rounded(features.with_outlier(_kept(s, d)).select("fly_id", "total_sleep_mean", "is_outlier")), f"WITH {GOOD} SELECT fly_id, round(total_sleep_mean, 4) AS total_sleep_mean, is_outlier FROM flagged"),
    "agg9_outlier_summary": (lambda s, d: features.outlier_summary(_kept(s, d)).withColumn("percent", F.round("percent", 1)), f"WITH {GOOD} SELECT genotype, sex, treatment, count(*) AS n, count(*) FILTER (is_outlier) AS n_outliers, round(count(*) FILTER (is_outlier) * 100.0 / count(*), 1) AS percent FROM flagged GROUP BY ALL"),
    "agg10_clean_features": (lambda s, d: rounded(features.clean(table(s, d)).select("fly_id", "sleep_latency_mean", "waso_mean", "mesor_sd", "amplitude_sd", "phase_sd")), f"WITH {GOOD} SELECT fly_id, {rnd(['sleep_latency_mean', 'waso_mean', 'mesor_sd', 'amplitude_sd', 'phase_sd'])} FROM clean"),
    "agg11_z_scores": (lambda s, d: rounded(features.z_scores(features.clean(table(s, d, True)))), f"WITH {GOOD} {PERIODOGRAM} SELECT {CH}, {STATS_Z} FROM clean LEFT JOIN pf USING (fly_id)"),
    "agg12_diagnostics": (_missing, f"WITH {FEATURES} {PERIODOGRAM} {GAPS}, wide AS (SELECT * FROM gap LEFT JOIN pf USING (fly_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n_rows FROM wide" for c in [*FLY, "rhythmic_days", "n_days", *ALL_NAMES, *PERIOD_NAMES])),
    "agg12_rows_with_missing": (lambda s, d: features.rows_with_missing(_gaps(table(s, d))), f"WITH {FEATURES} {GAPS} SELECT count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in ALL_NAMES)}) AS n_missing, count(*) AS n_rows FROM gap"),
    "flt7_removal": (lambda s, d: _removal(s, d)[0].select("event_id", "fly_id"), f"WITH {REMOVAL} SELECT event_id, fly_id FROM tag WHERE stage IS NULL"),
    "flt7_removal_counts": (lambda s, d: _removal(s, d)[1], f"WITH {REMOVAL} SELECT stage, count(*) AS n_rows, count(DISTINCT fly_id) AS n_flies FROM tag WHERE stage IS NOT NULL GROUP BY stage"),
}
