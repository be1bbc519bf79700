"""Tables laid out for how they are read: articles by session month, prices by ticker.

Articles lie in one folder per session month, and within a file in session and time order, so that a range of sessions reads
the folders and row groups it needs. Joined on session and month, the days of the other side prune the folders at run time.
Daily bars lie in buckets by ticker, sorted by date, so that windows and joins by ticker neither shuffle nor sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.sessions import SESSION
from tidewire.sources import commit

MONTH = "session_month"


def month_of(session: Column | str) -> Column:
    """The month of a date as text, so that a partition folder keeps it as it is."""
    return F.date_format(session, "yyyy-MM")


def publish_by_month(articles: DataFrame, target: str, session: str = SESSION, time: str = "date_utc") -> commit.Manifest:
    """A published table (see ``commit``) with a folder per session month.

    Rows are dealt by ranges of session and time, so a month of any size is spread over tasks and a hot session over
    files; a task writes few months. Rows without a session are in a folder of their own.
    """
    rows = articles.withColumn(MONTH, month_of(session))
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = rows.repartitionByRange(int(parts), MONTH, session, time).sortWithinPartitions(MONTH, session, time)
    return commit.publish(ordered, target, (MONTH,))


def read_months(spark: SparkSession, target: str, start=None, end=None, session: str = SESSION) -> DataFrame:
    """Articles of the sessions from ``start`` to ``end`` (both included; None is open); only their months' files are read."""
    rows = commit.read_published(spark, target)
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            day = F.lit(bound).cast("date")
            month, own = month_of(day), F.col(session)
            rows = rows.where((F.col(MONTH) >= month) & (own >= day)) if low else rows.where((F.col(MONTH) <= month) & (own <= day))
    return rows


def join_days(articles: DataFrame, days: DataFrame, session: str = SESSION, how: str = "inner") -> DataFrame:
    """``articles`` by month joined to ``days`` (one row per session, or few) on the session.

    The month is part of the condition, so the months that the days' filters leave decide which folders are read.
    """
    return articles.join(days.withColumn(MONTH, month_of(session)), [MONTH, session], how)


def bucket_prices(bars: DataFrame, path: str, buckets: int = 64, ticker: str = "ticker", date: str = "trading_date", name: str | None = None) -> DataFrame:
    """Daily bars as a table in ``buckets`` buckets by ticker, one file each, sorted by ticker and date.

    The table is registered in the session under ``name``; its files are below ``path``. More buckets than tickers
    leave some empty; with fewer, tickers share one.
    """
    spark = bars.sparkSession
    name = name or f"prices_{uuid.uuid4().hex}"
    (
        bars.repartition(buckets, ticker)
        .write.format("parquet").mode("errorifexists").option("path", path)
        .bucketBy(buckets, ticker).sortBy(ticker, date).saveAsTable(name)
    )
    return spark.table(name)
