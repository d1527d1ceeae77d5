"""Every command over a small recording made here: 32 channels, two sexes, two genotypes, five days of minutes."""

import datetime as dt
import random

import pytest

from tidemark import cli
from tidemark.sources import files, store


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    """A folder with a monitor file and a metadata file; channel 31 never moves, channel 32 has no metadata."""
    root, rng = tmp_path_factory.mktemp("recording"), random.Random(4)
    lines, t = [], dt.datetime(2025, 6, 20, 9)
    for k in range(5 * 24 * 60):
        stamp = t + dt.timedelta(minutes=k)
        head = f"{k + 1}\t{stamp.day} {stamp:%b %y}\t{stamp:%H:%M:%S}\t1\t0\t0\t0"
        light = 9 <= stamp.hour < 21
        counts = [0 if c == 30 or (k // 20 + c) % (2 + c % 3 + light) == 0 else rng.randint(0, 3 + c % 5 + 3 * light) for c in range(32)]
        for kind in ("MT", "CT", "Pn"):
            lines.append("\t".join([head, kind, "0", "0", *map(str, counts)]))
    (root / "raw").mkdir()
    (root / "raw" / "Monitor7.txt").write_text("\n".join(lines) + "\n")
    rows = ["Monitor Channel Genotype Sex Treatment"] + [f"7 ch{c} {['Iso', 'Fmn'][c % 2]} {['Female', 'Male'][c // 2 % 2]} VEH" for c in range(1, 32)]
    (root / "metadata.txt").write_text("\n".join(rows) + "\n")
    return root


def test_steps(spark, recording, tmp_path, capsys):
    run = lambda *argv: cli.main([str(a) for a in argv], spark)
    tables, out = tmp_path / "store", tmp_path / "results"
    run("filter-dates", "--input", recording / "raw", "--load", "06/20/25", "--days", 4, "--offset", 0, "--output", tmp_path / "filtered")
    assert spark.read.text(str(tmp_path / "filtered")).count() == 3 * 4 * 24 * 60
    run("prepare", "--store", tables, "--dam-files", recording / "raw", "--meta-path", recording / "metadata.txt", "--exclude-days", 1)
    health = store.read_experiment(spark, f"{tables}/health_reports", 1)
    assert health.count() == 31 and health.where("final_status = 'Dead'").select("channel").collect() == [(31,)]
    run("remove", "--store", tables, "--genotypes", "nobody", "--statuses", "Dead", "--per-fly-remove", '{"7-ch03": [2]}')
    readings = store.read_experiment(spark, f"{tables}/readings", 1)
    assert readings.select("fly_id").distinct().count() == 30 and readings.where("channel = 3 and exp_day = 2").count() == 0
    assert store.read_experiment(spark, f"{tables}/flies", 1).count() == 30
    run("features", "--store", tables, "--exclude-days", 1, "--build-sliding-window")
    rows = store.read_experiment(spark, f"{tables}/features_sliding_window", 1)
    assert rows.count() > 60 and {r.status for r in rows.select("status").distinct().collect()} <= {"alive", "dying", "dead"} and rows.where("total_activity > 0").count() > 0
    run("clean", "--store", tables, "--diagnostics", tmp_path / "diagnostics.txt")
    assert "Missing values" in (tmp_path / "diagnostics.txt").read_text()
    z = store.read_experiment(spark, f"{tables}/features_z", 1)
    assert z.count() > 20 and "periodogram_power_mean_z" in z.columns
    run("pca", "--store", tables, "--output-dir", out)
    run("clusters", "--pca-scores-csv", out / "pca_scores", "--min-cluster-size", 5, "--output-dir", out)
    found = files.read_csv(spark, f"{out}/umap_clusters")
    assert {"umap1", "cluster_dbscan", "cluster_hdbscan", "cluster_prob", "fly_id"} <= set(found.columns) and 10 < found.count() <= z.count()
    assert files.read_csv(spark, f"{out}/pca_scree").columns == ["component", "share", "cumulative"] and files.read_csv(spark, f"{out}/k_distances").count() == found.count()
    assert files.read_csv(spark, f"{out}/umap_density").count() % 2500 == 0 and files.read_csv(spark, f"{out}/umap_contours").count() > 0 and files.read_csv(spark, f"{out}/cluster_shares").count() > 0
    for name in ("sex-differences", "characterise"):
        run(name, "--store", tables, "--umap-clusters", f"{out}/umap_clusters", "--output-dir", out)
    assert files.read_csv(spark, f"{out}/cluster_feature_profiles").columns[0] == "feature"
    run("validate", "--umap-csv", f"{out}/umap_clusters", "--pca-csv", f"{out}/pca_scores", "--output-dir", out)
    assert "Stability" in (out / "validation.txt").read_text()
    run("forest", "--store", tables, "--no-tune", "--target", "sex", "--output-dir", out, "--pca-loadings-csv", f"{out}/pca_loadings")
    assert "accuracy" in (out / "classification_results.txt").read_text() and "forest_feature" in (out / "comparison.txt").read_text()
    run("delete-experiment", "--store", tables, "--list")
    assert "features_z" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("delete-experiment", "--store", tables)
    run("delete-experiment", "--store", tables, "--confirm", "--all")
    assert spark.read.parquet(f"{tables}/experiments").count() == 0 and not store.exists(spark, f"{tables}/readings/experiment_id=1")


def test_csv_steps(spark, recording, tmp_path):
    run = lambda *argv: cli.main([str(a) for a in argv], spark)
    run("prepare", "--dam-files", recording / "raw", "--meta-path", recording / "metadata.txt", "--output-data", tmp_path / "prepared", "--output-health", tmp_path / "health")
    run("remove", "--input", tmp_path / "prepared", "--health", tmp_path / "nothing", "--flies", "7-ch1", "--output", tmp_path / "cleaned")
    assert files.read_csv(spark, str(tmp_path / "cleaned")).select("fly_id").distinct().count() == 30
    run("features", "--input", tmp_path / "absent", tmp_path / "cleaned", "--output", tmp_path / "features", "--exclude-days", 1)
    run("clean", "--input", tmp_path / "features", "--output-clean", tmp_path / "clean", "--output-z", tmp_path / "z")
    assert "mesor_mean_z" in files.read_csv(spark, str(tmp_path / "z")).columns
    with pytest.raises(FileNotFoundError):
        files.first_of(spark, [str(tmp_path / "absent")])


def test_death_prediction(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for fly in range(30):
        for day in range(1, 9):
            left = 8 - day
            status = "dead" if left <= 1 else "dying" if left <= 3 else "alive"
            rows.append((f"M1_Ch{fly:02d}", day, 100.0 * left + rng.random(), rng.random(), 24.0 - left, status, left))
    spark.createDataFrame(rows, "fly_id string, exp_day int, total_activity double, activity_var double, longest_zero_hours double, status string, days_until_death int").write.option("header", True).csv(str(tmp_path / "rows"))
    for target in ("near_death", "auto"):
        made = cli.ml.fit_boosted
        cli.ml.fit_boosted = lambda a, b: made(a, b, depths=(2,), rates=(0.1,), rounds=5)
        try:
            cli.main(["death", "--sliding-window-csv", str(tmp_path / "rows"), "--target", target, "--exclude-longest-zero", "--output-dir", str(tmp_path / target)], spark)
        finally:
            cli.ml.fit_boosted = made
        text = (tmp_path / target / "death_prediction.txt").read_text()
        assert "accuracy" in text and ("status" if target == "auto" else "near_death") in text
        top = files.importances(spark, str(tmp_path / target / "death_importance")).where("rank = 1").first()
        assert top["feature"] == "total_activity"


def test_sync(spark, tmp_path, capsys):
    (tmp_path / "here" / "raw" / "deep").mkdir(parents=True)
    (tmp_path / "here" / "raw" / "a.txt").write_text("a")
    (tmp_path / "here" / "raw" / "deep" / "b.txt").write_text("bb")
    where = ["--local", str(tmp_path / "here"), "--bucket", f"file://{tmp_path}", "--prefix", "there", "--raw"]
    cli.main(["sync", "push", *where, "--dry-run"], spark)
    assert not (tmp_path / "there").exists() and "push" in capsys.readouterr().out
    cli.main(["sync", "push", *where], spark)
    assert (tmp_path / "there" / "raw" / "deep" / "b.txt").read_text() == "bb"
    (tmp_path / "there" / "raw" / ".a.txt.crc").unlink()
    (tmp_path / "there" / "raw" / "a.txt").write_text("longer")
    cli.main(["sync", "pull", *where], spark)
    assert (tmp_path / "here" / "raw" / "a.txt").read_text() == "longer"
