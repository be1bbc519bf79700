"""Queries that write files and read them back, and file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.numeric import rounded
from tidewire.functions.timefn import format_utc, parse_utc
from tidewire.operators import daily
from tidewire.operators.scoring import score_articles
from tidewire.operators.sessions import SESSION
from tidewire.plans import standins
from tidewire.plans.news_queries import _means_sql, _round_means
from tidewire.plans.registry import register
from tidewire.plans.sqlviews import news_time, with_views
from tidewire.session import materialise, scratch_path
from tidewire.sources import files, layout, news
from tidewire.sources.prices import read_prices
from tidewire.streaming import finished, incremental, ingest, rows


def _news_csv(spark: SparkSession, sf_dir: str) -> str:
    """All documents as raw news CSV; line breaks and quotes stay in the text."""
    path = scratch_path(spark, "news") + ".csv"
    rows = standins.articles(spark, sf_dir).select(
        "article_id", format_utc("date_utc").alias("Date"), "Article_title", "Stock_symbol"
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


_NEWS_SQL = f"""SELECT source AS Stock_symbol, {news_time('doc_id')} AS date_utc, count(*) AS n,
sum(length(text))::BIGINT AS chars, min(md5(text)) AS digest FROM documents GROUP BY 1, 2"""


def _digest(df: DataFrame) -> DataFrame:
    return df.groupBy("Stock_symbol", "date_utc").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("Article_title")).alias("chars"),
        F.min(F.md5("Article_title")).alias("digest"),
    )


@register("news_csv_scan", _NEWS_SQL)
def news_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(news.read_news(spark, _news_csv(spark, sf_dir)))


@register("csv_to_parquet", _NEWS_SQL)
def csv_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "converted")
    source = _news_csv(spark, sf_dir)
    files.csv_to_parquet(spark, source, target)
    files.csv_to_parquet(spark, source, target)  # a valid target is left alone
    return _digest(news.read_news(spark, target))


@register("save_by_ending", _NEWS_SQL)
def save_by_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.articles(spark, sf_dir).select("date_utc", "Article_title", "Stock_symbol")
    path = files.save(rows, scratch_path(spark, "saved") + ".csv")
    schema = T.StructType.fromDDL("date_utc string, Article_title string, Stock_symbol string")
    back = news.read_csv(spark, path, schema)
    return _digest(back.withColumn("date_utc", parse_utc("date_utc")))


@register(
    "price_csv_scan",
    with_views("prices", body="SELECT ticker, trading_date AS date, open, close, volume::DOUBLE AS volume FROM prices"),
)
def price_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "prices")
    bars = standins.prices(spark, sf_dir).withColumn("date", F.col("date").cast("string"))
    bars = bars.withColumn("ticker", F.concat(F.col("ticker"), F.lit(".csv")))
    bars.write.partitionBy("ticker").option("header", True).csv(path)
    rows = read_prices(spark, f"{path}/*", ["date", "open", "close", "volume"])
    return rows.select("ticker", "date", "open", "close", "volume")


@register(
    "stitch_parquet",
    with_views("daily_sentiment", body=f"""SELECT trading_session_date_utc, {_means_sql()}, daily_article_count
FROM daily_sentiment"""),
)
def stitch_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result files by time, stitched into one."""
    days = daily.daily_sentiment(standins.session_scores(spark, sf_dir))
    paths = [files.save(part, scratch_path(spark, name) + ".parquet") for name, part in (
        ("old", days.where(F.col(SESSION) < "1998-01-01")), ("new", days.where(F.col(SESSION) >= "1998-01-01")))]
    return _round_means(files.stitch(spark, paths, scratch_path(spark, "stitched")))


@register(
    "chunk_scan",
    "SELECT event_id // 1000 AS chunk, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1",
)
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks processed in two runs; the second finds all of them finished."""
    rows = standins.table(spark, sf_dir, "events").select("event_id")
    rows = ingest.chunked(rows, "event_id", 1000)
    target, ledger = scratch_path(spark, "chunks"), scratch_path(spark, "ledger")
    for _ in range(2):
        done = ingest.process_chunks(rows, "chunk", lambda df: df, target, ledger)
    return done.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high")
    )


@register(
    "score_in_chunks",
    """SELECT doc_id // 500 AS chunk, count(*) AS n,
round(avg(((length(text) - length(replace(text, 'o', '')))::DOUBLE / (length(text) + 1))::FLOAT::DOUBLE), 6)
+ 0.0::DOUBLE AS mean_share
FROM documents GROUP BY 1""",
)
def score_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring that can be resumed: the first run stops after the older texts, the second does the rest."""
    rows = standins.articles(spark, sf_dir).select("article_id", "date_utc", "Article_title")
    rows = ingest.chunked(rows, "article_id", 500)
    target, ledger = scratch_path(spark, "scored"), scratch_path(spark, "ledger")
    ingest.refuse_leftovers(spark, ledger)

    def score(df: DataFrame) -> DataFrame:
        return score_articles(df, standins.letter_scorer).drop("Article_title")

    for part in (rows.where("article_id < 500"), rows):
        done = ingest.process_chunks(part, "chunk", score, target, ledger)
    last = F.get("finbert_embedding", 3).cast("double")
    return done.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(last)).alias("mean_share")
    )


@register(
    "batch_map",
    "SELECT doc_id, length(text) AS chars FROM documents",
)
def batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "documents").select("doc_id", "text")
    return files.map_batches(
        rows, lambda batch: batch.assign(chars=batch["text"].str.len()).drop(columns="text"), "doc_id long, chars long"
    )


@register(
    "file_hashes",
    """SELECT regexp_extract(filename, '[^/]+$') AS file_name, size::BIGINT AS length, sha256(content) AS sha256
FROM read_blob('/root/testdata/sf0.01/*.parquet')""",
)
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_hashes(spark, sf_dir, "*.parquet")


# Streams


@register(
    "stream_symbol",
    "SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1",
)
def stream_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = standins.table(spark, sf_dir, "events").schema
    stream = ingest.article_stream(spark, sf_dir, schema, pattern="events.parquet")
    stream = stream.withColumnRenamed("event_type", "Stock_symbol")
    target = scratch_path(spark, "stream")
    ingest.drain(stream, target, scratch_path(spark, "stream-checkpoint"), symbol="click")
    rows = spark.read.parquet(target)
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "stream_first_rows",
    "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 90",
)
def stream_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = standins.table(spark, sf_dir, "events").schema
    stream = ingest.article_stream(spark, sf_dir, schema, pattern="events.parquet")
    target = scratch_path(spark, "stream")
    ingest.drain(stream.withColumnRenamed("event_type", "Stock_symbol"), target, scratch_path(spark, "cp"), "click")
    rows = ingest.first_rows(spark.read.parquet(target), 90, "ts", "event_id")
    return rows.select("event_id", "ts")


@register(
    "stream_daily_sentiment",
    with_views("daily_sentiment", body=f"SELECT trading_session_date_utc, {_means_sql()}, daily_article_count "
               "FROM daily_sentiment"),
)
def stream_daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles arriving as files, three files per micro-batch."""
    source = scratch_path(spark, "arrivals")
    scored = standins.scored_articles(spark, sf_dir).drop("finbert_embedding")
    scored.repartition(6, "article_id").write.parquet(source)
    stream = ingest.article_stream(spark, source, scored.schema, files_per_batch=3)
    target = scratch_path(spark, "partials")
    incremental.update_daily_sentiment(stream, standins.calendar(spark), target, scratch_path(spark, "cp"))
    return _round_means(incremental.current_daily_sentiment(spark, target))


@register(
    "stream_finished_sessions",
    with_views("daily_sentiment", body=f"SELECT trading_session_date_utc, {_means_sql()}, daily_article_count "
               "FROM daily_sentiment"),
)
def stream_finished_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles arriving in time order, four files one after another: sessions that are over, and the open ones."""
    folder, source = scratch_path(spark, "sessions"), scratch_path(spark, "arrivals")
    scored = materialise(standins.scored_articles(spark, sf_dir).drop("finbert_embedding"), "scored")
    low, high = scored.agg(F.min("date_utc"), F.max("date_utc")).first()
    cuts = [low + (high - low) * i / 4 for i in range(4)]
    for begin, end in zip(cuts, [*cuts[1:], None]):
        news.in_range(scored, "date_utc", begin, end, closed="left").coalesce(1).write.mode("append").parquet(source)
    stream = ingest.article_stream(spark, source, scored.schema, files_per_batch=1)
    finished.run_sessions(stream, standins.calendar(spark), folder)
    return _round_means(finished.session_rows(spark, folder).drop("finished"))


@register(
    "row_source",
    """SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS id_sum, min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY 1""",
)
def row_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events handed out by position; the first stream is stopped after two batches, the second does the rest."""
    path, schema = f"{sf_dir}/events.parquet", standins.table(spark, sf_dir, "events").schema
    total = standins.table(spark, sf_dir, "events").count()
    target, checkpoint = scratch_path(spark, "served"), scratch_path(spark, "served-checkpoint")
    for batches in (2, None):
        rows.run_rows(rows.row_stream(spark, path, schema, batch_rows=max(total // 5, 1)), target, checkpoint, batches)
    served = spark.read.parquet(target)
    return served.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@register(
    "row_source_filtered",
    "SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'",
)
def row_source_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = standins.table(spark, sf_dir, "events").schema
    found = rows.article_rows(spark, f"{sf_dir}/events.parquet", schema)
    return found.where("event_type = 'click'").select("event_id", "user_id", "ts")


@register(
    "articles_by_month",
    with_views("session_articles", body="""SELECT trading_session_date_utc, count(*) AS n, sum(length(Article_title))::BIGINT AS chars
FROM session_articles WHERE trading_session_date_utc BETWEEN DATE '1996-02-10' AND DATE '1997-03-05' GROUP BY 1"""),
)
def articles_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles laid out by session month; a range of sessions read back."""
    target = scratch_path(spark, "months")
    layout.publish_by_month(standins.session_articles(spark, sf_dir), target)
    found = layout.read_months(spark, target, "1996-02-10", "1997-03-05")
    return found.groupBy(SESSION).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("Article_title")).alias("chars"))
