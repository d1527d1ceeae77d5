"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def names():
    from tidemark import plans

    return sorted(k for k, (_, sql) in plans.registered().items() if sql)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    from tidemark import plans

    query, sql = plans.registered()[name]
    got = query(spark, DATA)
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = Counter(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_stay_in_the_jvm(spark):
    """Minute-level chains hold no Python."""
    from tidemark import plans

    for name in ("agg2_daily_metrics", "win6_sleep_daily", "sta1_cosinor", "agg8_iqr_bounds", "win17_rolling_states"):
        text = plans.registered()[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text, name
