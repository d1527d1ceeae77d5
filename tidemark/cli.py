"""Command line: ``python -m tidemark.cli <step> ...``. Each step reads tables, builds one plan, and writes tables.

Tables lie under ``--store`` as Parquet, one folder each, partitioned by experiment_id. A step works on the latest experiment
unless ``--experiment-id`` names one. Analyses read z-scored features from the store or from ``--csv-input``, and write CSV
folders and a text report to ``--output-dir``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.operators import cluster, features, health, ml, plots, sliding, stats
from tidemark.operators.lineage import cut
from tidemark.schemas import EXCLUDE_DAYS, FLY, LIGHTS_OFF, LIGHTS_ON, META, REF_DAY, Z_FEATURES
from tidemark.sources import files, monitor, store

TABLES = [*reversed(store.CHILDREN), "experiments"]


def experiment(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.experiment_id is not None:
        return a.experiment_id
    row = store.latest(spark.read.parquet(f"{a.store}/experiments")).first()
    if row is None:
        raise SystemExit("the store holds no experiment")
    return row["experiment_id"]


def stored(spark: SparkSession, a: argparse.Namespace, name: str, number: int) -> DataFrame:
    return store.read_experiment(spark, f"{a.store}/{name}", number).drop("experiment_id")


def z_features(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """z-scored features with their fly's columns."""
    if a.csv_input:
        return files.read_csv(spark, a.csv_input)
    return stored(spark, a, "features_z", experiment(spark, a))


def z_columns(df: DataFrame) -> list[str]:
    return [f"{c}_z" for c in Z_FEATURES if f"{c}_z" in df.columns]


def filled(df: DataFrame, names: list[str]) -> list[str]:
    """The columns that at least half of the rows have, the others are named in the output: models leave out rows with a gap, and
    a feature without spread has no z."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names]).first()
    used = [c for c in names if row[c] and 2 * row[c] >= row["_n"]]
    if len(used) < len(names):
        print("left out, as fewer than half of the rows have it: " + ", ".join(c for c in names if c not in used))
    return used


def minute_bins(readings: DataFrame) -> DataFrame:
    """Movement readings as bins of one minute."""
    return readings.where("reading_type = 'MT'").withColumn("n", F.col("value"))


def filter_dates(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = monitor.filter_lines(monitor.read_lines(spark, a.input), monitor.parse_load_date(a.load), a.days, a.offset)
    lines.write.mode("overwrite").partitionBy("monitor").text(a.output or f"{a.input.rstrip('/')}_filtered")


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    readings = monitor.to_readings(monitor.parse_lines(monitor.read_lines(spark, a.dam_files)), active_only=False)
    meta = monitor.parse_metadata(spark.read.text(a.meta_path))
    start = a.exp_start or str(readings.agg(F.to_date(F.min("datetime"))).first()[0])
    ready = monitor.prepare(readings, meta, start, a.lights_on, (start, a.exp_end or "9999-12-31") if a.apply_date_filter else None)
    used = minute_bins(ready).where(~F.col("exp_day").isin(a.exclude_days)) if a.exclude_days else minute_bins(ready)
    daily = health.daily_metrics(used, lights_on=a.lights_on, lights_off=a.lights_off)
    days = health.irreversible(health.with_status(health.with_decline(daily, a.ref_day)))
    found = health.health_report(days)
    if a.output_data:
        store.to_csv(ready, a.output_data)
        store.to_csv(found, a.output_health or f"{a.output_data}_health")
        return
    number = store.claim_id(spark, a.store)
    commit = store.Commit(spark, a.store, number)
    commit.write("readings", ready)
    commit.write("flies", ready.select(*FLY).distinct())
    commit.write("health_reports", found.join(health.last_day_metrics(days), "fly_id", "left"))
    commit.finish()
    # the experiment is known when all of it is there
    row = spark.createDataFrame([(number, start, dt.datetime.now())], "experiment_id int, start string, created_at timestamp")
    row.write.mode("append").parquet(f"{a.store}/experiments")


def remove(spark: SparkSession, a: argparse.Namespace) -> None:
    given = any((a.flies, a.per_fly_remove, a.genotypes, a.sexes, a.treatments, a.statuses))
    rules = {
        "flies": a.flies, "days": monitor.removal_criteria(a.per_fly_remove or "{}"), "genotypes": a.genotypes, "sexes": a.sexes,
        "treatments": a.treatments, "statuses": a.statuses if given else ["Dead"],
    }
    if a.input:
        readings = files.first_of(spark, [a.input])
        found = files.optional(spark, a.health)
        found = readings.select("fly_id").distinct().withColumn("final_status", F.lit(None).cast("string")) if found is None else found
        kept, counts = features.remove_flies(readings, found, **rules)
        store.to_csv(kept, a.output)
    else:
        number = experiment(spark, a)
        readings = stored(spark, a, "readings", number)
        kept, counts = features.remove_flies(readings, stored(spark, a, "health_reports", number), **rules)
        gone = readings.select("fly_id").distinct().join(kept.select("fly_id").distinct(), "fly_id", "left_anti").withColumn("experiment_id", F.lit(number))
        there = store.manifest(spark, a.store, number)
        tables = {t: store.read_experiment(spark, f"{a.store}/{t}", number) for t in store.CHILDREN if t != "readings" and t in there}
        commit = store.Commit(spark, a.store, number)
        commit.write("readings", kept)
        for name, left in store.delete_flies(tables, cut(gone)).items():
            commit.write(name, left)
        commit.finish()
    counts.show(truncate=False)


def feature_table(spark: SparkSession, a: argparse.Namespace) -> None:
    number = None if a.input else experiment(spark, a)
    readings = files.first_of(spark, a.input) if a.input else stored(spark, a, "readings", number)
    table = features.feature_table(minute_bins(features.usable_rows(readings)), 1, a.sleep_threshold, tuple(a.exclude_days))
    if a.input:
        store.to_csv(table, a.output)
        if a.build_sliding_window:
            store.to_csv(sliding_table(readings, a), a.output_sliding_window or f"{a.output}_sliding_window")
        return
    commit = store.Commit(spark, a.store, number)
    commit.write("features", table)
    if a.build_sliding_window:
        commit.write("features_sliding_window", sliding_table(readings, a))
    commit.finish()


def sliding_table(readings: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Rows of the trailing day of all readings, labelled by each day's status."""
    every = minute_bins(features.usable_rows(readings))
    days = health.irreversible(health.with_status(health.with_decline(health.daily_metrics(every))))
    return sliding.sliding_rows(every, days, 1, a.sleep_threshold)


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    number = None if a.input else experiment(spark, a)
    table = files.read_csv(spark, a.input) if a.input else stored(spark, a, "features", number)
    good = features.clean(table, a.iqr_multiplier)
    z = features.z_scores(good)
    if a.input:
        store.to_csv(good, a.output_clean)
        store.to_csv(z, a.output_z)
    else:
        store.write_partition(z, f"{a.store}/features_z", number)
    if a.diagnostics:
        kept = table.where(~features.is_problem())
        text = files.report({
            "Removed flies": features.problem_flies(table).select("fly_id", "total_sleep_mean", "total_bouts_mean"),
            "Outliers by group": features.outlier_summary(kept, multiplier=a.iqr_multiplier), "Missing values": features.diagnostics(table),
        })
        files.write_text(spark, text, a.diagnostics)


def pca(spark: SparkSession, a: argparse.Namespace) -> None:
    df = z_features(spark, a)
    names = filled(df, z_columns(df))
    scored, load, share = ml.pca(df, names)
    wide = [F.get("scores", F.lit(i)).alias(f"PC{i + 1}") for i in range(len(share))]
    store.to_csv(scored.select(*[c for c in FLY if c in df.columns], *wide), f"{a.output_dir}/pca_scores")
    store.to_csv(plots.scree(spark, share), f"{a.output_dir}/pca_scree")
    rows = [(n, *map(float, r)) for n, r in zip(names, load, strict=True)]
    store.to_csv(spark.createDataFrame(rows, ["feature", *[f"PC{i + 1}" for i in range(len(share))]]), f"{a.output_dir}/pca_loadings")
    store.to_csv(stats.compare_groups(stats.to_long(df, ["fly_id", "genotype"], names), "genotype"), f"{a.output_dir}/genotype_comparison_summary")


def clusters(spark: SparkSession, a: argparse.Namespace) -> None:
    df = files.read_csv(spark, a.pca_scores_csv) if a.pca_scores_csv else z_features(spark, a)
    names = [c for c in df.columns if c.lower().startswith("pc")] or filled(df, z_columns(df))
    keyed = df.where(F.forall(F.array(*names), lambda v: v.isNotNull())).withColumn("key", F.xxhash64("fly_id")).withColumn("v", F.array(*[F.col(c).cast("double") for c in names]))
    flat = ml.umap(keyed, "key", "v")
    points = flat.select("key", F.array("umap1", "umap2").alias("v"))
    eps = a.dbscan_eps
    if eps is None:
        curve = cut(plots.k_distances(cluster.knn(points, "key", "v", a.dbscan_k + 1), a.dbscan_k))
        store.to_csv(curve.select("place", "distance"), f"{a.output_dir}/k_distances")
        row = cluster.elbow(curve, "distance").first()
        eps = float(row["distance"]) if row else 0.0
    dense = cluster.dbscan(points, "key", "v", eps, a.dbscan_k + 1).withColumnRenamed("cluster", "cluster_dbscan")
    grown = ml.hdbscan(points, "key", "v", a.min_cluster_size, a.min_samples).select("key", F.col("cluster").alias("cluster_hdbscan"), F.col("strength").alias("cluster_prob"))
    out = keyed.select("key", *[c for c in FLY if c in keyed.columns]).join(flat, "key").join(dense, "key").join(grown, "key").drop("key")
    out = cut(out)
    store.to_csv(out, f"{a.output_dir}/umap_clusters")
    grid = cut(plots.density(out, "umap1", "umap2", "genotype"))
    store.to_csv(grid, f"{a.output_dir}/umap_density")
    store.to_csv(plots.contours(grid, "genotype"), f"{a.output_dir}/umap_contours")
    store.to_csv(plots.shares(out, "cluster_dbscan", "genotype"), f"{a.output_dir}/cluster_shares")
    store.to_csv(stats.contingency(out, "cluster_hdbscan", "genotype"), f"{a.output_dir}/cluster_genotype_enrichment")


def sex_differences(spark: SparkSession, a: argparse.Namespace) -> None:
    df = cluster.with_clusters(z_features(spark, a), files.read_csv(spark, a.umap_clusters))
    tests = stats.composition(df, "sex", "cluster").withColumn("group", F.lit("all"))
    for g in sorted(r[0] for r in df.select("genotype").distinct().collect()):  # genotypes are a handful
        tests = tests.unionByName(stats.composition(df.where(F.col("genotype") == g), "sex", "cluster").withColumn("group", F.lit(g)))
    store.to_csv(tests.withColumn("significant", F.col("p_value") < a.alpha), f"{a.output_dir}/sex_composition_tests")
    long = stats.to_long(df, ["fly_id", "sex", "cluster"], z_columns(df))
    found = stats.benjamini_hochberg(stats.mann_whitney(long, ["cluster", "feature"], F.lower("sex").startswith("f")), ["cluster"], "p_value", "feature")
    found = files.display_names(found.withColumn("significant", F.col("p_adj") < a.alpha))
    store.to_csv(found.orderBy("cluster", "p_adj", "feature"), f"{a.output_dir}/sex_diff_within_clusters")


def characterise(spark: SparkSession, a: argparse.Namespace) -> None:
    df = cluster.with_clusters(z_features(spark, a), files.read_csv(spark, a.umap_clusters))
    long = stats.to_long(df, ["fly_id", "cluster"], z_columns(df))
    found = stats.benjamini_hochberg(stats.one_vs_rest(long, "cluster"), ["cluster"], "p_value", "feature")
    found = files.display_names(found.withColumn("significant", F.col("p_adj") < a.alpha))
    store.to_csv(found.orderBy("cluster", "p_adj", "feature"), f"{a.output_dir}/cluster_feature_profiles")
    store.to_csv(files.display_names(stats.medians(long, "cluster")), f"{a.output_dir}/cluster_signatures_summary")


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    got = files.read_csv(spark, a.umap_csv)
    both = cluster.with_clusters(files.read_csv(spark, a.pca_csv), got, noise=True)
    pcs = [f"pc{i}" for i in range(1, a.n_pcs + 1) if f"pc{i}" in both.columns]
    points = both.withColumn("key", F.xxhash64("fly_id")).withColumn("v", F.array(*[F.col(c).cast("double") for c in pcs]))
    inner = cluster.centroid_scores(cluster.components_long(points, "key", "cluster", "v"), "cluster").join(F.broadcast(cluster.silhouette(points, "key", "cluster", "v")))
    store.to_csv(inner, f"{a.output_dir}/internal_metrics")
    store.to_csv(cluster.agreement(cluster.without_noise(both, "cluster"), "cluster", "genotype"), f"{a.output_dir}/external_metrics")
    grid = ml.stability_grid(points, "key", "v", "genotype")
    store.to_csv(grid, f"{a.output_dir}/stability_grid")
    effects = stats.cohens_d(stats.to_long(cluster.without_noise(both, "cluster"), ["key", "cluster"] if "key" in both.columns else ["fly_id", "cluster"], pcs), "cluster")
    top = cluster.top_k(effects, ["cluster"], F.abs("d"), a.top_n_features, "feature")
    files.write_text(spark, files.report({"Stability": ml.stability_verdict(grid), "Largest effects": top}), f"{a.output_dir}/validation.txt")


def forest(spark: SparkSession, a: argparse.Namespace) -> None:
    df = z_features(spark, a).where(tp.is_ok(F.col(a.target)))
    if a.treatment_filter:
        df = df.where(F.upper("treatment") == a.treatment_filter.upper())
    names = filled(df, z_columns(df))
    classes = sorted(r[0] for r in df.groupBy(a.target).count().where("count >= 2").select(a.target).collect())  # labels are a handful
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(a.target))
    rows = ml.as_vectors(df.where(number > 0).withColumn("label", (number - 1).cast("double")), names)
    rows = ml.stratified_split(rows, "fly_id", "label", (1 - a.test_size - a.val_size, a.val_size, a.test_size), a.random_state)
    model = ml.fit_forest(rows.where("part != 'test'") if a.tune else rows.where("part = 'train'"), tune=a.tune, seed=a.random_state)
    tested = model.transform(rows.where("part = 'test'"))
    weight = spark.createDataFrame(list(zip(names, map(float, model.featureImportances.toArray()), strict=True)), "feature string, importance double")
    store.to_csv(weight.orderBy(F.desc("importance"), "feature"), f"{a.output_dir}/feature_importance")
    files.write_text(spark, files.report({"Classes": ", ".join(f"{i} {c}" for i, c in enumerate(classes)) + "\n", "Metrics": ml.metrics(tested), "Confusion": ml.confusion(tested)}), f"{a.output_dir}/classification_results.txt")
    if a.pca_loadings_csv:
        table = ml.ranking_table(files.importances(spark, f"{a.output_dir}/feature_importance"), files.loadings(spark, a.pca_loadings_csv))
        files.write_text(spark, files.text_table(table.orderBy("rank")), f"{a.output_dir}/comparison.txt")


def death(spark: SparkSession, a: argparse.Namespace) -> None:
    df = files.read_csv(spark, a.sliding_window_csv) if a.sliding_window_csv else stored(spark, a, "features_sliding_window", experiment(spark, a))
    target = a.target
    if target == "auto":
        target = "status" if df.select("status").distinct().count() > 1 else "near_death"
    if target == "near_death":
        df = sliding.near_death(df, a.near_death_days).withColumn("label", F.col("near_death").cast("double"))
    else:
        df = df.withColumn("label", F.array_position(F.array(*[F.lit(v) for v in ("alive", "dying", "dead")]), F.col("status")).cast("double") - 1)
    left_out = {"label", "near_death", "exp_day", "experiment_id", "channel", "days_until_death", *(["longest_zero_hours"] if a.exclude_longest_zero else [])}
    names = [c for c, t in df.dtypes if t in ("int", "bigint", "double") and c not in left_out]
    rows = ml.group_split(ml.as_vectors(df.where("label >= 0").fillna(0.0, names), names), "fly_id", F.col("label"))
    model = ml.fit_boosted(rows.where("part = 'train'"), rows.where("part = 'val'"))
    tested = model.transform(rows.where("part = 'test'"))
    files.write_text(spark, files.report({"Target": target + "\n", "Metrics": ml.metrics(tested), "Confusion": ml.confusion(tested)}), f"{a.output_dir}/death_prediction.txt")
    named = spark.createDataFrame([(f"x{i}", c) for i, c in enumerate(names)], "feature string, name string")
    importance = ml.shap_importance(model, rows.where("part = 'train'"), rows.where("part = 'test'"), "fly_id").join(F.broadcast(named), "feature")
    store.to_csv(importance.select(F.col("name").alias("feature"), "importance").orderBy(F.desc("importance"), "feature"), f"{a.output_dir}/death_importance")


def delete_experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.list:
        there = {t: df for t in TABLES if t != "experiments" and (df := store.read_table(spark, f"{a.store}/{t}")) is not None}
        there["experiments"] = spark.read.parquet(f"{a.store}/experiments")
        store.counts(there).orderBy("experiment_id", "table").show(1000, truncate=False)
        return
    if not a.confirm:
        raise SystemExit("nothing is deleted without --confirm")
    known = spark.read.parquet(f"{a.store}/experiments")
    numbers = [r[0] for r in known.select("experiment_id").collect()] if a.all else [experiment(spark, a)]
    for number in numbers:
        store.drop_experiment(spark, a.store, number)
    left = known.where(~F.col("experiment_id").isin(numbers))
    left.write.mode("overwrite").parquet(f"{a.store}/experiments__next")
    spark.read.parquet(f"{a.store}/experiments__next").write.mode("overwrite").parquet(f"{a.store}/experiments")
    store.remove(spark, f"{a.store}/experiments__next")


def sync(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files that one side lacks or that differ in size; push and pull copy them, status only lists them."""
    remote = f"{a.bucket.rstrip('/')}/{a.prefix}".rstrip("/")
    parts = [p for p in ("raw", "filtered", "processed", "results") if getattr(a, p)] or ["raw", "filtered", "processed", "results"]
    for part in parts:
        here, there = f"{a.local}/{part}", f"{remote}/{part}"
        plan = store.listing_difference(store.listing(spark, here), store.listing(spark, there))
        if a.action == "status" or a.dry_run:
            plan.groupBy("state").count().show()
            continue
        source, target = (here, there) if a.action == "push" else (there, here)
        store.copy_files(plan.where(F.col("state").isin(a.action, "differs")), source, target)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    steps = p.add_subparsers(dest="step", required=True)

    def step(name, run, *groups):
        s = steps.add_parser(name)
        s.set_defaults(run=run)
        if "store" in groups:
            s.add_argument("--store", default="tidemark-store")
            s.add_argument("--experiment-id", type=int)
        if "analysis" in groups:
            s.add_argument("--csv-input")
            s.add_argument("--output-dir", default="analysis_results")
        return s

    s = step("filter-dates", filter_dates)
    s.add_argument("--input", required=True)
    s.add_argument("--load", required=True)
    s.add_argument("--days", type=int, required=True)
    s.add_argument("--offset", type=int, required=True)
    s.add_argument("--output")
    s = step("prepare", prepare, "store")
    s.add_argument("--dam-files", required=True)
    s.add_argument("--meta-path", required=True)
    s.add_argument("--lights-on", type=float, default=LIGHTS_ON)
    s.add_argument("--lights-off", type=float, default=LIGHTS_OFF)
    s.add_argument("--apply-date-filter", action="store_true")
    s.add_argument("--exp-start")
    s.add_argument("--exp-end")
    s.add_argument("--ref-day", type=int, default=REF_DAY)
    s.add_argument("--exclude-days", type=int, nargs="*", default=list(EXCLUDE_DAYS))
    s.add_argument("--output-data")
    s.add_argument("--output-health")
    s = step("remove", remove, "store")
    for name in ("--flies", "--genotypes", "--sexes", "--treatments", "--statuses"):
        s.add_argument(name, nargs="*", default=[])
    s.add_argument("--per-fly-remove", type=lambda t: json.dumps(json.loads(t)))
    s.add_argument("--input")
    s.add_argument("--health")
    s.add_argument("--output", default="dam_data_cleaned.csv")
    s = step("features", feature_table, "store")
    s.add_argument("--exclude-days", type=int, nargs="*", default=list(EXCLUDE_DAYS))
    s.add_argument("--sleep-threshold", type=int, default=5)
    s.add_argument("--input", nargs="*", help="CSV readings; the first that is there is taken")
    s.add_argument("--output", default="ML_features.csv")
    s.add_argument("--build-sliding-window", action="store_true", help="also the trailing-day rows that the death step reads")
    s.add_argument("--output-sliding-window")
    s = step("clean", clean, "store")
    s.add_argument("--iqr-multiplier", type=float, default=1.5)
    s.add_argument("--input")
    s.add_argument("--output-clean", default="ML_features_clean.csv")
    s.add_argument("--output-z", default="ML_features_z.csv")
    s.add_argument("--diagnostics")
    step("pca", pca, "store", "analysis")
    s = step("clusters", clusters, "store", "analysis")
    s.add_argument("--pca-scores-csv")
    s.add_argument("--min-cluster-size", type=int, default=10)
    s.add_argument("--min-samples", type=int, default=3)
    s.add_argument("--dbscan-k", type=int, default=5)
    s.add_argument("--dbscan-eps", type=float)
    for name, run in (("sex-differences", sex_differences), ("characterise", characterise)):
        s = step(name, run, "store", "analysis")
        s.add_argument("--umap-clusters", required=True)
        s.add_argument("--alpha", type=float, default=0.05)
    s = step("validate", validate, "analysis")
    s.add_argument("--umap-csv", required=True)
    s.add_argument("--pca-csv", required=True)
    s.add_argument("--n-pcs", type=int, default=5)
    s.add_argument("--top-n-features", type=int, default=10)
    s = step("forest", forest, "store", "analysis")
    s.add_argument("--target", choices=META, default="genotype")
    s.add_argument("--treatment-filter")
    s.add_argument("--test-size", type=float, default=0.2)
    s.add_argument("--val-size", type=float, default=0.16)
    s.add_argument("--no-tune", dest="tune", action="store_false")
    s.add_argument("--random-state", type=int, default=42)
    s.add_argument("--pca-loadings-csv")
    s = step("death", death, "store", "analysis")
    s.add_argument("--sliding-window-csv")
    s.add_argument("--target", choices=["auto", "status", "near_death"], default="auto")
    s.add_argument("--near-death-days", type=int, default=2)
    s.add_argument("--exclude-longest-zero", action="store_true")
    s = step("delete-experiment", delete_experiment, "store")
    s.add_argument("--all", action="store_true")
    s.add_argument("--confirm", action="store_true")
    s.add_argument("--list", action="store_true")
    s = step("sync", sync)
    s.add_argument("action", choices=["push", "pull", "status"])
    s.add_argument("--local", default=".")
    s.add_argument("--bucket", required=True, help="any filesystem URL that Spark opens")
    s.add_argument("--prefix", default="")
    for name in ("--raw", "--filtered", "--processed", "--results", "--dry-run"):
        s.add_argument(name, action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName(f"tidemark {a.step}").getOrCreate(), a)


if __name__ == "__main__":
    main()
