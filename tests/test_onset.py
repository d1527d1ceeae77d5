"""Onset and offset where a mean lies on the threshold itself."""

from tidemark.operators import rhythm


def test_a_mean_on_the_threshold_is_not_above_it(spark):
    # two hours of v and 3 v make the threshold v / 3, the mean around the first of them
    rows = [("0", 1, "Iso", "Female", "VEH", str(v), 1, zt, {5: v / 100, 15: 3 * v / 100}.get(zt, 0.0)) for v in range(101, 301) for zt in range(24)]
    hourly = spark.createDataFrame(rows, "monitor string, channel int, genotype string, sex string, treatment string, fly_id string, exp_day int, zt int, hourly_mt double")
    got = rhythm.onset_offset(hourly).collect()
    assert len(got) == 200 and {(r.onset_zt, r.offset_zt) for r in got} == {(14, 16)}
