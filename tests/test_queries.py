"""Every registered query against DuckDB on the smallest tables."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert difference(df, duck, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# Costly chains; the models in them have tests of their own.
SLOW = {"study_hybrid_tfidf", "grid_search", "randomized_search", "random_sweep", "replay_runs", "pca_tfidf"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["trading_session_date_utc", "avg_pos", "avg_neg", "avg_neu", "daily_article_count"]
    assert df.count() > 0
