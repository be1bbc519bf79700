"""Files, logs and streams."""

import hashlib
import os
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import naming
from tidewire.functions.timefn import format_utc, is_not_midnight, parse_date, parse_utc, time_bucket, to_zone
from tidewire.operators import daily, quality
from tidewire.operators.calendar import trading_calendar
from tidewire.operators.sessions import SESSION, assign_sessions
from tidewire.session import materialise, scratch_path, shared_dir, spread
from tidewire.sources import blocks, files, news
from tidewire.sources.prices import first_days, read_prices
from tidewire.streaming import incremental, ingest

NEWS = (
    "Date,Article_title,Stock_symbol,Extra\n"
    '2020-06-01 14:30:00 UTC,"Tech, rally",AAPL,1\n'
    '2020-06-02 00:00:00 UTC,"He said ""up""\nand left",AAPL,2\n'
    "not a date,Broken date,MSFT,3\n"
    "2020-06-03 09:00:00 UTC,рынок растёт,AAPL,4\n"
    "2020-06-04 09:00:00 UTC,,AAPL,5\n"
)


@pytest.fixture
def news_csv(tmp_path):
    path = tmp_path / "news.csv"
    path.write_text(NEWS, encoding="utf-8")
    return str(path)


def test_csv_scan(spark, news_csv):
    df = news.read_news(spark, news_csv)
    assert df.columns == ["date_est", "date_utc", "Article_title", "Stock_symbol"]
    rows = df.collect()
    assert len(rows) == 5
    assert rows[0]["date_utc"] == datetime(2020, 6, 1, 14, 30) and rows[0]["date_est"] == datetime(2020, 6, 1, 10, 30)
    assert rows[1]["Article_title"] == 'He said "up"\nand left'
    assert rows[2]["date_utc"] is None


def test_load_filters(spark, news_csv):
    def titles(**kw):
        return {r["Article_title"] for r in news.load_news(spark, news_csv, **kw).collect()}

    assert titles(symbol="MSFT") == {"Broken date"}
    assert titles(filter_russian=True) == {"Tech, rally", 'He said "up"\nand left', "Broken date"}
    start = datetime(2020, 6, 2, tzinfo=timezone.utc)
    assert titles(start=start, end=datetime(2020, 6, 3, 9)) == {'He said "up"\nand left', "рынок растёт"}
    moved = datetime(2020, 6, 3, 5, tzinfo=timezone(timedelta(hours=-4)))
    assert titles(start=moved) == {"рынок растёт", None}


def test_results_do_not_depend_on_the_session_zone(spark, news_csv):
    before = spark.conf.get("spark.sql.session.timeZone")
    expected = news.load_news(spark, news_csv, start=datetime(2020, 6, 1, 14, 30)).collect()
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert news.load_news(spark, news_csv, start=datetime(2020, 6, 1, 14, 30)).collect() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_skipped_hours_of_the_session_zone_stay(spark):
    """02:30 on this day does not exist in New York, midnight not on the other in Sao Paulo."""
    times = [datetime(2020, 3, 8, 2, 30), datetime(2020, 3, 8, 3, 10), datetime(2018, 11, 4)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(format_utc("t"), parse_utc(format_utc("t")), is_not_midnight("t"), time_bucket("t", "minute")).collect()
            assert [r[0] for r in got] == [f"{t} UTC" for t in times]
            assert [r[1] for r in got] == times
            assert [r[2] for r in got] == [True, True, False]
            assert [tuple(r[3]) for r in got] == [(t.date(), t.hour, t.minute) for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sources_go_on_after_a_bad_path(spark, news_csv, tmp_path):
    merged, report = news.load_sources(spark, {"a": news_csv, "gone": str(tmp_path / "gone.csv"), "b": news_csv})
    assert {r[0]: r[1] for r in merged.groupBy("source_name").count().collect()} == {"a": 5, "b": 5}
    got = {r["source_name"]: (r["loaded"], r["file_name"]) for r in report.collect()}
    assert got == {"a": (True, "news.csv"), "gone": (False, "gone.csv"), "b": (True, "news.csv")}
    nothing, _ = news.load_sources(spark, {"gone": str(tmp_path / "gone.csv")})
    assert nothing is None


def test_bad_fields_become_null(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("date,close\n2020-01-01,1.5\n2020-01-02,oops\n")
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("close", T.DoubleType())])
    rows = news.read_csv(spark, str(path), schema, keep_bad_rows=True).collect()
    assert [(r["close"], r["_corrupt_record"]) for r in rows] == [(1.5, None), (None, "2020-01-02,oops")]


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,open,high,low,close,volume\n2020-01-01,1,2,3,4,5\n")
    (tmp_path / "b.csv").write_text("date,close,high,low,open,volume\n2020-01-01,1,2,3,4,5\n")
    with pytest.raises(Exception, match="header"):
        read_prices(spark, f"{tmp_path}/*.csv").collect()


def test_price_files(spark, tmp_path):
    for ticker, close in (("AAPL", 1.0), ("BRK B+", 2.0)):
        (tmp_path / f"{ticker}.csv").write_text(
            f"open,date,high,low,close,volume\n1,2020-01-02,1,1,{close},9\n1,2020-01-01,1,1,{close},9\n"
        )
    df = read_prices(spark, f"{tmp_path}/*.csv")
    assert df.columns == ["date", "close", "ticker"] and df.schema["date"].dataType == T.DateType()
    assert {(r["ticker"], r["close"]) for r in df.collect()} == {("AAPL", 1.0), ("BRK B+", 2.0)}
    assert {r["date"].day for r in first_days(df, 2).collect()} == {1}


def test_conversion_is_idempotent(spark, news_csv, tmp_path):
    target = str(tmp_path / "out.parquet")
    assert files.csv_to_parquet(spark, news_csv, target)
    assert not files.csv_to_parquet(spark, news_csv, target)
    for folder, _, names in os.walk(target):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "wb") as broken:
                    broken.write(b"junk")
            elif name.endswith(".crc"):
                os.remove(os.path.join(folder, name))
    assert files.csv_to_parquet(spark, news_csv, target)
    converted = news.read_news(spark, target)
    assert converted.count() == 5
    raw = news.read_csv(spark, news_csv).withColumn("idx", F.xxhash64("Article_title"))
    copy = converted.select(F.xxhash64("Article_title").alias("idx"), format_utc("date_utc").alias("Date"))
    row = quality.compare_copies(raw, copy, "idx", ["Date"]).first()
    assert (row["compared"], row["mismatches"], row["left_nulls"], row["right_nulls"]) == (5, 0, 0, 1)


def test_save_by_ending(spark, news_csv, tmp_path):
    df = news.read_news(spark, news_csv).drop("date_est")
    assert files.save(df, str(tmp_path / "plain")) == str(tmp_path / "plain.parquet")
    assert spark.read.parquet(str(tmp_path / "plain.parquet")).count() == 5
    files.save(df, str(tmp_path / "t.csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "t.csv"))
    assert back.first()["date_utc"] == "2020-06-01 14:30:00 UTC" and back.count() == 5
    with pytest.raises(ValueError):
        files.save(df, str(tmp_path / "t.xlsx"))


def test_chunks_skip_broken_files(spark, tmp_path):
    for n in (2, 10, 1):
        pd.DataFrame({"x": [n] * n}).to_parquet(tmp_path / f"backup_chunk_{n}.parquet")
    (tmp_path / "backup_chunk_55.parquet").write_bytes(b"PAR1 broken PAR1")
    got = files.read_chunks(spark, str(tmp_path)).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r["chunk"], r["count"]) for r in got] == [(1, 1), (2, 2), (10, 10)]
    paths = [str(tmp_path / f"backup_chunk_{n}.parquet") for n in (1, 2)]
    assert files.stitch(spark, paths, str(tmp_path / "all")).count() == 3


def test_hashes(spark, news_csv, tmp_path):
    row = files.file_hashes(spark, str(tmp_path), "*.csv").first()
    assert row["sha256"] == hashlib.sha256(NEWS.encode()).hexdigest() and row["file_name"] == "news.csv"


def test_hashes_of_empty_and_oddly_named_files(spark, tmp_path):
    content = {"a.csv": b"abc", "empty.csv": b"", "sp ace.csv": b"x", "h#q.csv": b"z", "p%41+.csv": b"y"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = files.file_hashes(spark, str(tmp_path)).collect()
    assert {(r["file_name"], r["length"], r["sha256"]) for r in rows} == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}
    assert len(rows) == len(content)


@pytest.fixture
def short_cells(spark):
    """No file of more than 100 bytes can be a cell, as on any input none of more than 2 GB can."""
    most = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(most, "100")
    yield
    spark.conf.unset(most)


def test_files_that_tasks_open_are_never_read_whole(spark, tmp_path, short_cells):
    content = {"long.csv": b"0123456789" * 1000, "short.csv": b"x", "empty.csv": b""}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = files.file_hashes(spark, str(tmp_path), "*.csv")
    assert sorted(map(tuple, found.collect())) == sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items())


def test_long_files_of_a_store_that_only_spark_opens(spark, tmp_path, short_cells, monkeypatch):
    monkeypatch.setattr(blocks, "WHOLE", 50)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.hashes.link./in", f"file://{tmp_path}")
    content = {"long.csv": b"0123456789" * 1000, "h#q p%41.csv": b"y" * 51, "edge.csv": b"z" * 50, "short.csv": b"x", "empty.csv": b""}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = files.file_hashes(spark, "viewfs://hashes/in", "*.csv")
    assert sorted(map(tuple, found.collect())) == sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items())


def test_batches_are_bounded(spark):
    df = spark.range(1000).repartition(2)
    sizes = files.map_batches(df, lambda b: pd.DataFrame({"n": [len(b)]}), "n long", 100)
    got = [r["n"] for r in sizes.collect()]
    assert sum(got) == 1000 and max(got) <= 100


def test_time_functions(spark):
    rows = [("2020-01-31 12:00:00 UTC",), ("2020-01-31 12:00:00",), ("2020-13-31 12:00:00 UTC",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(parse_utc("t")).collect()] == [datetime(2020, 1, 31, 12), None, None, None]
    days = spark.createDataFrame([("2020-02-30",), ("2020-02-29",), ("x",)], "t string")
    assert [str(r[0]) for r in days.select(parse_date("t", strict=False)).collect()] == ["None", "2020-02-29", "None"]
    stamps = spark.createDataFrame([(datetime(2020, 7, 1, 0, 0, 0, 1),), (datetime(2020, 1, 1),)], "t timestamp_ntz")
    got = stamps.select(is_not_midnight("t"), to_zone("t")).collect()
    assert [r[0] for r in got] == [True, False]
    assert [r[1].hour for r in got] == [20, 19]
    paths = spark.createDataFrame([("/a/b/backup_chunk_12.parquet",), ("x.csv",)], "p string")
    assert [tuple(r) for r in paths.select(naming.file_name("p"), naming.chunk_number("p")).collect()] == [
        ("backup_chunk_12.parquet", 12), ("x.csv", None)]
    assert naming.single_value_grid({"C": 1}) == {"C": [1]}


def test_shared_folder(spark, tmp_path):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(10)
    assert materialise(df, "ten").count() == 10
    assert spread(df.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = df.repartition(64)
    assert spread(wide, "id") is wide


def test_spread_bounds_the_input_of_a_task(spark):
    df = spark.range(1000).coalesce(2)  # 8 bytes a row
    assert spread(df, "id", most=100).rdd.getNumPartitions() == 80
    assert spread(df, "id", most=1 << 20).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


# Streams


def write_articles(spark, folder, part, n):
    rows = [(part * 1000 + i, datetime(2024, 1, 2 + i % 4, (i * 5) % 24), "AAPL" if i % 3 else "MSFT", 0.2, 0.3, 0.5) for i in range(n)]
    schema = "article_id long, date_utc timestamp_ntz, Stock_symbol string, sent_pos double, sent_neg double, sent_neu double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_stream_by_symbol_counts_each_file_once(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = write_articles(spark, folder, 0, 30)
    for part in range(1, 4):
        ingest.drain(ingest.article_stream(spark, folder, schema, 1), target, checkpoint, "AAPL")
        ingest.drain(ingest.article_stream(spark, folder, schema, 1), target, checkpoint, "AAPL")
        done = spark.read.parquet(target)
        assert done.count() == part * 20 == done.select("article_id").distinct().count()
        write_articles(spark, folder, part, 30)
    first = ingest.first_rows(spark.read.parquet(target), 5, "date_utc", "article_id")
    assert first.count() == 5


def test_incremental_equals_batch(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    calendar = trading_calendar(spark, datetime(2023, 12, 20).date(), datetime(2024, 1, 20).date())
    assert incremental.current_daily_sentiment(spark, target).count() == 0
    for part in range(3):
        schema = write_articles(spark, folder, part, 40)
        stream = ingest.article_stream(spark, folder, schema, 1)
        incremental.update_daily_sentiment(stream, calendar, target, checkpoint)
        batch = daily.daily_sentiment(assign_sessions(spark.read.parquet(folder), calendar=calendar))
        got = {r[SESSION]: tuple(r)[1:] for r in incremental.current_daily_sentiment(spark, target).collect()}
        expected = {r[SESSION]: tuple(r)[1:] for r in batch.collect()}
        assert got.keys() == expected.keys()
        assert all(got[d] == pytest.approx(expected[d]) for d in got)


def test_repeated_batch_is_not_counted_twice(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    calendar = trading_calendar(spark, datetime(2023, 12, 20).date(), datetime(2024, 1, 20).date())
    schema = write_articles(spark, folder, 0, 40)
    for run in range(2):  # a lost checkpoint replays batch 0
        stream = ingest.article_stream(spark, folder, schema)
        incremental.update_daily_sentiment(stream, calendar, target, str(tmp_path / f"cp{run}"))
    total = incremental.current_daily_sentiment(spark, target).agg(F.sum("daily_article_count")).first()[0]
    assert total == 40


def test_chunks_resume(spark, tmp_path):
    target, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    calls = []

    def work(df):
        calls.append(sorted(r[0] for r in df.select("chunk").distinct().collect()))
        return df.withColumn("y", F.col("id") * 2)

    ingest.refuse_leftovers(spark, ledger)
    first = ingest.chunked(spark.range(25), "id", 10)
    ingest.process_chunks(first, "chunk", work, target, ledger)
    with pytest.raises(FileExistsError):
        ingest.refuse_leftovers(spark, ledger)
    more = ingest.chunked(spark.range(45), "id", 10).where("id < 25 OR id >= 30")
    done = ingest.process_chunks(more, "chunk", work, target, ledger)
    assert calls == [[0, 1, 2], [3, 4]]
    assert sorted(r["id"] for r in done.collect()) == [*range(25), *range(30, 45)]


def test_lost_chunk_job_is_repeated_whole(spark, tmp_path):
    target, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    rows = ingest.chunked(spark.range(20), "id", 10)
    # a run that wrote one chunk and died before the ledger
    rows.where("chunk = 0").limit(5).write.partitionBy("chunk").parquet(target)
    done = ingest.process_chunks(rows, "chunk", lambda df: df, target, ledger)
    assert sorted(r["id"] for r in done.collect()) == list(range(20))


def test_one_broken_part_among_forty(spark, tmp_path):
    path = tmp_path / "parts.parquet"
    spark.range(400).repartition(40).write.parquet(str(path))
    assert files.readable_parquet(spark, str(path))
    broken = sorted(path.glob("part-*.parquet"))[-1]
    path.joinpath(f".{broken.name}.crc").unlink()
    broken.write_bytes(b"no footer")
    assert not files.readable_parquet(spark, str(path))
    assert not files.readable_parquet(spark, str(tmp_path / "gone.parquet"))
