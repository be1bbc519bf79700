"""Shapes of the physical plans, and skewed inputs."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidewire.operators import daily, quality, splits, tfidf
from tidewire.operators.calendar import trading_calendar
from tidewire.operators.sessions import SESSION, assign_sessions

QUERIES = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(text: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<(.*?)>", text)


def test_scans_read_only_what_they_need(spark, sf_dir):
    assert schemas(plan(QUERIES["session_assign"](spark, sf_dir))) == ["doc_id:bigint"]
    assert set(schemas(plan(QUERIES["confusion"](spark, sf_dir)))) == {"doc_id:bigint,quality:int"}
    ranged = plan(QUERIES["time_range_filter"](spark, sf_dir))
    assert schemas(ranged) == ["event_id:bigint,ts:timestamp_ntz"]
    assert "GreaterThanOrEqual(ts,2024-01-08" in ranged and "LessThanOrEqual(ts,2024-01-19" in ranged
    assert "EqualTo(source,src3)" in plan(QUERIES["symbol_filter"](spark, sf_dir))


def test_text_path_stays_in_the_jvm(spark, sf_dir):
    for name in ("token_counts", "tfidf_weights", "clean_text_nostem", "daily_embedding", "daily_sentiment"):
        assert "Python" not in plan(QUERIES[name](spark, sf_dir)), name


def test_splits_do_not_move_rows(spark, sf_dir, tmp_path):
    rows = QUERIES["price_timeline"](spark, sf_dir)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for made in (
        splits.tail_split(rows, "trading_date", "ticker", eager=True),
        splits.three_way_split(rows, "trading_date", "ticker", eager=True),
        splits.fold_blocks(rows, "trading_date", "ticker", eager=True),
    ):
        assert "Exchange" not in plan(made)


def test_sessions_do_not_move_articles(spark, sf_dir):
    text = plan(QUERIES["session_assign"](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_dates_only_for_positions(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "a")], "t timestamp_ntz, k string")
    with pytest.raises(ValueError):
        splits.tail_split(df, "t", "k")


# A third of all rows in one group.


def hot_articles(spark, n=3000):
    hot = datetime(2024, 1, 8)
    rows = [(i, hot if i % 3 == 0 else datetime(2024, 1, 2) + timedelta(hours=i % 500), f"word{i % 7} hot") for i in range(n)]
    return spark.createDataFrame(rows, "article_id long, date_utc timestamp_ntz, Article_title string")


def test_hot_session(spark):
    calendar = trading_calendar(spark, date(2023, 12, 20), date(2024, 2, 10))
    placed = assign_sessions(hot_articles(spark), calendar=calendar)
    counts = tfidf.daily_tokens(placed)
    assert counts.agg(F.sum("tf")).first()[0] == 6000
    parts = daily.session_text(placed, max_chars=1000)
    assert parts.agg(F.max(F.length("daily_text"))).first()[0] < 3000
    found = parts.select(F.explode(F.split("daily_text", " ")).alias("w"))
    assert found.count() == 6000
    assert parts.groupBy(SESSION).count().agg(F.max("count")).first()[0] >= 10


def test_hot_title(spark):
    schema = "Article_title string, date_est timestamp_ntz, id long"
    stamp = datetime(2024, 1, 1)
    a = spark.createDataFrame([("same" if i % 3 else f"a{i}", stamp, i) for i in range(900)], schema)
    b = spark.createDataFrame([("other" if i % 3 else f"a{i}", stamp, i) for i in range(900)], schema)
    diff = quality.title_difference(a, b, ("a", "b"), keep=["id"])
    assert {(r["source"], r["count"]) for r in diff.groupBy("source").count().collect()} == {("a", 600), ("b", 600)}
    assert quality.title_overlap(a, b).first()[0] == 300


def test_words_are_stemmed_once(spark):
    rows = spark.createDataFrame([(date(2020, 1, 1), "running runs the ran")], "trading_session_date_utc date, Article_title string")
    plan = tfidf.daily_tokens(rows, stemmed=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_small_sessions_are_one_aggregation(spark):
    rows = spark.createDataFrame([(date(2020, 1, 1), datetime(2020, 1, 1), i, "a") for i in range(5)], "trading_session_date_utc date, date_utc timestamp_ntz, article_id long, Article_title string")
    plan = daily.session_text(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
