"""Rows by position, sessions with a watermark, and physical layouts."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import daily, prices
from tidewire.operators.calendar import trading_calendar
from tidewire.operators.sessions import SESSION, assign_sessions
from tidewire.sources import layout
from tidewire.streaming import finished, ingest, rows


@pytest.fixture
def source(spark, tmp_path):
    """1,000 rows in three files of many row groups."""
    path = str(tmp_path / "rows")
    made = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, "A").otherwise("B").alias("symbol"), F.col("id").cast("string").alias("title"))
    made.repartitionByRange(3, "id").write.option("parquet.block.size", "2048").parquet(path)
    return path, made.schema


def test_rows_stop_and_resume(spark, source, tmp_path, monkeypatch):
    path, schema = source
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    rows.run_rows(rows.row_stream(spark, path, schema, batch_rows=130), target, checkpoint, batches=3)
    half = spark.read.parquet(target).count()
    assert 0 < half < 1000
    rows.run_rows(rows.row_stream(spark, path, schema, batch_rows=130), target, checkpoint)
    ids = sorted(r.id for r in spark.read.parquet(target).collect())
    assert ids == list(range(1000))


def test_rows_end_after_the_nth_match(spark, source, tmp_path):
    path, schema = source
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds its rows served
        rows.run_rows(rows.row_stream(spark, path, schema, batch_rows=90, symbol=("symbol", "A"), most=40), target, checkpoint)
        assert sorted(r.id for r in spark.read.parquet(target).collect()) == [7 * i for i in range(40)]


def test_filters_are_pushed(spark, source):
    path, schema = source
    found = rows.article_rows(spark, path, schema).where("symbol = 'A' and id < 100").select("id")
    assert sorted(r.id for r in found.collect()) == list(range(0, 100, 7))
    reader = rows.BatchReader(path, schema)
    left = list(reader.pushFilters([rows.EqualTo(("symbol",), "A"), rows.EqualTo(("a", "b"), 1)]))
    assert reader.wanted == [("symbol", "A")] and len(left) == 1
    served = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert served == 143


def scored(spark, days):
    made = [(i, d, 0.2 + 0.1 * (i % 3), 0.3, 0.5 - 0.1 * (i % 3)) for i, d in enumerate(days)]
    return spark.createDataFrame(made, "article_id long, date_utc timestamp_ntz, sent_pos double, sent_neg double, sent_neu double")


def test_sessions_finish_once_and_late_rows_are_counted(spark, tmp_path):
    calendar = trading_calendar(spark, date(2020, 1, 1), date(2020, 3, 31))
    folder, arrivals = str(tmp_path / "s"), str(tmp_path / "in")
    first = [datetime(2020, 1, 6, 10) + timedelta(hours=5 * i) for i in range(120)]
    late = [datetime(2020, 1, 7, 9), datetime(2020, 1, 7, 10), datetime(2020, 1, 9, 9)]
    more = [first[-1] + timedelta(hours=5 * (i + 1)) for i in range(40)]
    schema = scored(spark, []).schema

    def run(days):
        scored(spark, days).coalesce(1).write.mode("append").parquet(arrivals)
        finished.run_sessions(ingest.article_stream(spark, arrivals, schema), calendar, folder, delay="3 days")

    run(first)
    before = {r[SESSION]: r for r in finished.session_rows(spark, folder).collect()}
    assert any(r.finished for r in before.values()) and not all(r.finished for r in before.values())
    want = {r[SESSION]: r for r in daily.daily_sentiment(assign_sessions(scored(spark, first), "date_utc", calendar)).collect()}
    assert {s: r.daily_article_count for s, r in before.items()} == {s: r.daily_article_count for s, r in want.items()}
    assert all(abs(before[s].avg_pos - want[s].avg_pos) < 1e-12 for s in want)
    assert finished.late_articles(spark, folder).count() == 0
    run(late + more)
    after = {r[SESSION]: r for r in finished.session_rows(spark, folder).collect()}
    assert all(after[s].daily_article_count == r.daily_article_count for s, r in before.items() if r.finished)
    assert sum(r.finished for r in after.values()) > sum(r.finished for r in before.values())
    assert spark.read.parquet(f"{folder}/finished").groupBy(SESSION).count().where("count > 1").count() == 0
    counted = {r[SESSION]: r.late for r in finished.late_articles(spark, folder).collect()}
    assert counted == {date(2020, 1, 7): 2, date(2020, 1, 9): 1}
    total = sum(r.daily_article_count for r in after.values()) + sum(counted.values())
    assert total == len(first + late + more)


def test_months_prune_files(spark, tmp_path):
    days = [datetime(2020, 1, 1) + timedelta(days=i) for i in range(366)]
    articles = scored(spark, days).withColumn(SESSION, F.to_date("date_utc"))
    target = str(tmp_path / "m")
    layout.publish_by_month(articles, target)
    table = layout.read_months(spark, target, date(2020, 3, 10), date(2020, 4, 5))
    assert table.count() == 27
    files = table.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("2020-03" in r.f or "2020-04" in r.f for r in files)
    picked = spark.createDataFrame([(date(2020, 5, 4), 1), (date(2020, 9, 9), 0)], f"{SESSION} date, pick int")
    picked.write.parquet(str(tmp_path / "days"))
    chosen = spark.read.parquet(str(tmp_path / "days")).where("pick = 1")
    joined = layout.join_days(layout.read_months(spark, target), chosen)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert [r.article_id for r in joined.collect()] == [124]


def test_bucketed_prices_do_not_shuffle(spark, tmp_path):
    bars = [(f"t{k}", date(2020, 1, 1) + timedelta(days=i), float(i + k + 1)) for k in range(6) for i in range(50)]
    plain = spark.createDataFrame(bars, "ticker string, trading_date date, close double")
    table = layout.bucket_prices(plain, str(tmp_path / "b"), buckets=4)
    steps = [prices.with_returns, lambda df: prices.with_label(prices.with_returns(df)), lambda df: prices.with_lags(prices.with_returns(df))]
    for step in steps:
        made = step(table)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(made.collect(), key=str) == sorted(step(plain).collect(), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = table.join(table.select("ticker", F.col("trading_date").alias("d")), "ticker").groupBy("ticker").count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
