"""Pairs of groups in both directions."""


def test_pairs_are_named_in_both_directions(spark, monkeypatch):
    from tidemark.plans import small, statistics

    rows = [("f", "Female", 1.0), ("f", "Female", 3.0), ("f", "Male", 2.0), ("f", "Male", 0.0)]
    monkeypatch.setattr(statistics, "long", lambda s, d: spark.createDataFrame(rows, "feature string, sex string, value double"))
    df = small._mirrored(spark, "")
    assert sorted(map(tuple, df.collect())) == [("f", "Female vs Male", 0.5), ("f", "Male vs Female", -0.5)]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
