"""Native tails against scalar functions by other means."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import native, tails


def values(spark, rows, make, *names):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    return [r[0] for r in df.select("i", make(*[F.col(n) for n in names]).alias("p")).orderBy("i").select("p").collect()]


def test_gamma_and_erfc(spark):
    xs = [1e-3, 0.5, 1, 2, 3.7, 12, 100.5, 1e4]
    assert values(spark, [(x,) for x in xs], native.ln_gamma, "x") == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-13)
    zs = [-5, -1, 0, 1e-9, 0.3, 1, 2, 4, 8, 15, 25]
    assert values(spark, [(z,) for z in zs], native.erfc, "z") == pytest.approx([math.erfc(z) for z in zs], rel=1e-11)
    assert values(spark, [(z,) for z in zs], native.normal_p, "z") == pytest.approx([tails.normal_two_sided(z) for z in zs], rel=1e-11)


def test_tails(spark):
    chi = [(x, d) for x in (0, 0.01, 1, 5, 30, 200) for d in (1, 2, 3, 10, 77)]
    assert values(spark, chi, native.chi2_p, "x", "d") == pytest.approx([tails.chi2_tail(*r) for r in chi], rel=1e-10, abs=1e-300)
    f = [(x, a, b) for x in (0, 0.1, 1, 4, 50) for a in (1, 2, 9) for b in (1, 5, 40, 3000)]
    assert values(spark, f, native.f_p, "x", "a", "b") == pytest.approx([tails.f_tail(*r) for r in f], rel=1e-9, abs=1e-290)
    tables = [(8, 2, 1, 5), (0, 3, 3, 0), (10, 10, 10, 10), (0, 0, 4, 1), (200, 3, 150, 40)]
    assert values(spark, tables, native.fisher_p, *"abcd") == pytest.approx([tails.fisher_exact(*r) for r in tables], rel=1e-9)
    cells = [(2, 2, 4), (10, 30, 100), (1, 1, 1), (50, 60, 100)]
    assert values(spark, cells, native.expected_information, *"abn") == pytest.approx([tails.expected_cell(*r) for r in cells], rel=1e-9, abs=1e-12)
    tukey = [(q, k, d) for q in (0, 0.5, 3.877, 8) for k in (2, 3, 7) for d in (3, 10, 60, 9000)]
    assert values(spark, tukey, native.tukey_p, "q", "k", "d") == pytest.approx([tails.studentized_range_tail(*r) for r in tukey], abs=2e-8)
    null = spark.createDataFrame([(None,)], "x double").select(*[f.alias(str(i)) for i, f in enumerate((native.normal_p("x"), native.chi2_p(F.col("x"), F.lit(2)), native.f_p(F.col("x"), F.lit(2), F.lit(3)), native.tukey_p(F.col("x"), F.lit(3), F.lit(4)), native.fisher_p(*[F.col("x")] * 4)))])
    assert list(null.first()) == [None] * 5
    plan = null._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
