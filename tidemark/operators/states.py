"""Five-minute states of flies: bins, time of death, rolling baselines, state labels, bouts, and quality control."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.runs import with_run_id
from tidemark.schemas import META

DEATH_BINS, SHORT_BINS, ROLL_BINS, WARMUP_BINS, SD_FLOOR = 144, 6, 288, 144, 0.01
STATES = ["Healthy", "Declining", "Critical"]
ID = ["fly_id", *META]


def five_minute_bins(readings: DataFrame, per_bin: int = 5, minutes: int = 5) -> DataFrame:
    """(fly, bin_start, mt_sum, pn_var) of the bins that hold exactly ``per_bin`` times with both MT and Pn; no variance is 0."""
    wide = readings.groupBy(*ID, "datetime").pivot("reading_type", ["MT", "Pn"]).agg(F.first("value"))
    wide = wide.where(F.col("MT").isNotNull() & F.col("Pn").isNotNull())
    bins = wide.groupBy(*ID, F.window("datetime", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("MT").alias("mt_sum"), F.coalesce(F.var_samp("Pn"), F.lit(0.0)).alias("pn_var"))
    return bins.where(F.col("n") == per_bin).select(*ID, F.col("w.start").alias("bin_start"), "mt_sum", "pn_var")


def time_of_death(bins: DataFrame, death_bins: int = DEATH_BINS) -> DataFrame:
    """(fly_id, time_of_death): start of the first run of at least ``death_bins`` bins without movement and variance."""
    still = (F.col("mt_sum") == 0) & (F.col("pn_var") == 0)
    runs = with_run_id(bins.withColumn("still", still), ["fly_id"], "bin_start", F.col("still")).where("still")
    each = runs.groupBy("fly_id", "run_id").agg(F.count(F.lit(1)).alias("n"), F.min("bin_start").alias("start")).where(F.col("n") >= death_bins)
    return each.groupBy("fly_id").agg(F.min("start").alias("time_of_death"))


def raw_states(bins: DataFrame, death_bins: int = DEATH_BINS, short: int = SHORT_BINS) -> DataFrame:
    """Dead from the time of death on, Sleep without movement, else Active; active runs shorter than ``short`` are Sleep."""
    dead = bins.join(time_of_death(bins, death_bins), "fly_id", "left")
    state = F.when(F.col("bin_start") >= F.col("time_of_death"), "Dead").when(F.col("mt_sum") == 0, "Sleep").otherwise("Active")
    runs = with_run_id(dead.withColumn("raw_state", state), ["fly_id"], "bin_start", F.col("raw_state"))
    size = F.count(F.lit(1)).over(Window.partitionBy("fly_id", "run_id"))
    brief = (F.col("raw_state") == "Active") & (size < short)
    return runs.withColumn("_n", size).withColumn("raw_state", F.when(brief, "Sleep").otherwise(F.col("raw_state"))).drop("run_id", "_n")


def rolling_states(bins: DataFrame, roll: int = ROLL_BINS, warmup: int = WARMUP_BINS, floor: float = SD_FLOOR) -> DataFrame:
    """z-scores of active bins against the fly's trailing ``roll`` bins, and the state: Dead, Sleep, Warmup, Low_Data, HMM_candidate.

    Only active bins count in a frame; a deviation below ``floor`` of the fly's own is raised to it and marks Low_Data.
    """
    w = Window.partitionBy("fly_id").orderBy("bin_start")
    back, so_far, fly = w.rowsBetween(-(roll - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("fly_id")
    active = F.col("raw_state") == "Active"
    df = bins.withColumn("active_count", F.sum(active.cast("int")).over(so_far))
    for name, col in (("mt", "mt_sum"), ("pn", "pn_var")):
        x = F.when(active, F.col(col).cast("double"))
        df = df.withColumn(f"_{name}_m", F.avg(x).over(back)).withColumn(f"_{name}_s", F.stddev_samp(x).over(back)).withColumn(f"_{name}_f", F.lit(floor) * F.stddev_samp(x).over(fly))
        z = F.try_divide(F.col(col) - F.col(f"_{name}_m"), F.greatest(f"_{name}_s", f"_{name}_f"))
        df = df.withColumn(f"{name}_z", F.when(active, z))
    low = F.coalesce((F.col("_mt_s") < F.col("_mt_f")) | (F.col("_pn_s") < F.col("_pn_f")), F.lit(False))
    state = F.when(~active, F.col("raw_state")).when(F.col("active_count") < warmup, "Warmup").when(low, "Low_Data").otherwise("HMM_candidate")
    return df.withColumn("state", state).drop(*[f"_{n}_{k}" for n in ("mt", "pn") for k in "msf"])


def gap_bouts(events: DataFrame, keys: list[str], ts: str = "datetime", gap_minutes: float = 5) -> DataFrame:
    """Bouts of times that lie at most ``gap_minutes`` apart: keys, bout, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    opens = F.coalesce((gap > gap_minutes * 60e6).cast("int"), F.lit(1))
    marked = events.withColumn("_o", opens).withColumn("bout", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "bout").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def _forward(pi, a, like):
    n, k = like.shape
    alpha, scale = np.empty((n, k)), np.empty(n)
    row = pi * like[0]
    for t in range(n):
        if t:
            row = (alpha[t - 1] @ a) * like[t]
        scale[t] = max(row.sum(), 1e-300)
        alpha[t] = row / scale[t]
    return alpha, scale


def _density(x, mean, var):
    return np.exp(-0.5 * ((x[:, None] - mean) ** 2 / var).sum(2)) / np.sqrt((2 * np.pi * var).prod(1)) + 1e-300


def fit_hmm(seqs: list[np.ndarray], k: int = 3, tries: int = 4, rounds: int = 500, tol: float = 1e-8):
    """EM for a Gaussian HMM with independent emissions; starts come from quantiles that spread out with each failed try.

    Returns (pi, transitions, means, variances), or None if no try converges to finite numbers.
    """
    data = np.concatenate(seqs)
    for attempt in range(tries):
        spread = 1 + 0.5 * attempt
        lo, hi = max(0.05, 0.15 - 0.1 * (spread - 1)), min(0.95, 0.85 + 0.1 * (spread - 1))
        mean = np.quantile(data, np.linspace(lo, hi, k), axis=0)
        var = np.tile(np.maximum(data.var(0), 1e-6), (k, 1))
        pi, a, last = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), -np.inf
        for _ in range(rounds):
            total, first, trans, weight, s1, s2 = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros_like(mean), np.zeros_like(mean)
            for x in seqs:
                like = _density(x, mean, var)
                alpha, scale = _forward(pi, a, like)
                beta = np.ones((len(x), k))
                for t in range(len(x) - 2, -1, -1):
                    beta[t] = a @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
                gamma = alpha * beta
                gamma /= gamma.sum(1, keepdims=True)
                if len(x) > 1:
                    trans += a * (alpha[:-1].T @ (like[1:] * beta[1:] / scale[1:, None]))
                first += gamma[0]
                weight += gamma.sum(0)
                s1 += gamma.T @ x
                s2 += gamma.T @ (x * x)
                total += np.log(scale).sum()
            pi, a = first / first.sum(), trans / np.maximum(trans.sum(1, keepdims=True), 1e-300)
            mean = s1 / np.maximum(weight, 1e-300)[:, None]
            var = np.maximum(s2 / np.maximum(weight, 1e-300)[:, None] - mean**2, 1e-6)
            if not np.isfinite(total):
                break
            if abs(total - last) <= tol * abs(total):
                return pi, a, mean, var
            last = total
        else:
            return pi, a, mean, var
    return None


def viterbi(x: np.ndarray, pi, a, mean, var) -> np.ndarray:
    score, la = np.log(pi + 1e-300) + np.log(_density(x[:1], mean, var)[0]), np.log(a + 1e-300)
    logs, back = np.log(_density(x, mean, var)), np.zeros((len(x), len(pi)), int)
    for t in range(1, len(x)):
        step = score[:, None] + la
        back[t] = step.argmax(0)
        score = step.max(0) + logs[t]
    path = [int(score.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return np.array(path[::-1])


def hmm_states(bins: DataFrame, least: int = 200, group: str = "genotype") -> DataFrame:
    """(fly_id, genotype, bin_start, state) of candidate bins, decoded by one HMM for each genotype.

    States are named by falling means of (mt_z, pn_z). Genotypes with fewer than ``least`` bins are left out; those whose fit
    fails read HMM_FAILED. One task holds a genotype's candidate bins: the model is fitted on all of its flies together.
    """

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame({"fly_id": [], group: [], "bin_start": pd.Series([], dtype="datetime64[us]"), "state": []})
        pdf = pdf.sort_values(["fly_id", "bin_start"])
        seqs = [g[["mt_z", "pn_z"]].to_numpy(float) for _, g in pdf.groupby("fly_id", sort=True)]
        model = fit_hmm(seqs)
        out = pdf[["fly_id", group, "bin_start"]].copy()
        if model is None:
            return out.assign(state="HMM_FAILED")
        path, x = np.concatenate([viterbi(s, *model) for s in seqs]), np.concatenate(seqs)
        means = np.array([x[path == s].mean(0) if (path == s).any() else [-np.inf, -np.inf] for s in range(3)])
        names = dict(zip(np.lexsort((-means[:, 1], -means[:, 0])), STATES, strict=True))
        return out.assign(state=[names[s] for s in path])

    picked = bins.where("state = 'HMM_candidate' and mt_z is not null and pn_z is not null").select("fly_id", group, "bin_start", "mt_z", "pn_z")
    stamp = dict(bins.dtypes)["bin_start"]
    return picked.groupBy(group).applyInPandas(decode, f"fly_id string, {group} string, bin_start {stamp}, state string")


def state_shares(bins: DataFrame, state: str = "state", names: tuple[str, ...] = ("Dead", "Sleep", "Warmup", "Low_Data", "HMM_candidate")) -> DataFrame:
    """Percent of each state for each fly, rounded to one digit, and the first time of each."""
    share = [F.bround(F.avg((F.col(state) == n).cast("int")) * 100, 1).alias(f"pct_{n.lower()}") for n in names]
    first = [F.min(F.when(F.col(state) == n, F.col("bin_start"))).alias(f"first_{n.lower()}") for n in names]
    return bins.groupBy(*ID).agg(F.count(F.lit(1)).alias("n_bins"), *share, *first)


def candidate_bouts(bins: DataFrame, gap_minutes: float = 5, least: int = SHORT_BINS) -> DataFrame:
    """The candidate bins that lie in bouts of at least ``least`` bins, with ``bout``; a gap of more than ``gap_minutes`` ends a bout."""
    w = Window.partitionBy("fly_id").orderBy("bin_start")
    gap = F.timestamp_diff("SECOND", F.lag("bin_start").over(w), F.col("bin_start")) > 60 * gap_minutes
    opens = F.when(F.row_number().over(w) == 1, 1).otherwise(gap.cast("int"))
    marked = bins.where("state = 'HMM_candidate'").withColumn("_o", opens).withColumn("bout", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy("fly_id", "bout"))
    return marked.withColumn("_o", size).where(F.col("_o") >= least).drop("_o")


def with_decoded(bins: DataFrame, decoded: DataFrame) -> DataFrame:
    """Bins whose candidates have the state that the model gave them; candidates without one leave, other bins stay."""
    named = bins.join(decoded.select("fly_id", "bin_start", F.col("state").alias("_s")), ["fly_id", "bin_start"], "left")
    return named.withColumn("state", F.when(F.col("state") == "HMM_candidate", F.col("_s")).otherwise(F.col("state"))).where("state is not null").drop("_s")


def quality_table(bins: DataFrame) -> DataFrame:
    """Exclude flies with any dead bins, keep the others. Flies of a genotype whose model failed (a state HMM_FAILED) get one row
    that says so, without shares."""
    failed = bins.groupBy("genotype").agg(F.bool_or(F.col("state") == "HMM_FAILED").alias("_failed"))
    shares = state_shares(bins).join(F.broadcast(failed), "genotype")
    decision = F.when(F.col("_failed"), "HMM_FAILED").when(F.col("pct_dead") > 0, "Exclude").otherwise("Keep")
    blank = [F.when(~F.col("_failed"), F.col(c)).alias(c) if c not in ID else F.col(c) for c in shares.columns if c != "_failed"]
    return shares.select(*blank, decision.alias("decision"))


def quality_summary(table: DataFrame) -> DataFrame:
    """For each genotype and decision: flies, median shares, percent of the genotype's flies."""
    got = table.groupBy("genotype", "decision").agg(F.count(F.lit(1)).alias("n"), F.median("pct_dead").alias("median_dead"), F.median("pct_sleep").alias("median_sleep"))
    return got.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy("genotype")))
