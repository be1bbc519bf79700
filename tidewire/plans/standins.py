"""Views that let the star-schema test tables play news and prices.

Every view covers the whole of its tables.
"""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.numeric import softmax
from tidewire.operators.calendar import trading_calendar
from tidewire.operators.sessions import assign_sessions
from tidewire.session import GATHERED_BYTES, spread

# Span of all stand-in dates; the data cannot leave it, so no job looks for bounds.
FIRST_DAY, LAST_DAY = date(1994, 12, 1), date(2024, 12, 31)
EMBEDDING_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession) -> DataFrame:
    return trading_calendar(spark, FIRST_DAY, LAST_DAY)


def _news_time(key: str):
    """Hours spread over 2,000 days, weekends and the evening included."""
    day = F.date_add(F.lit(date(1995, 1, 2)), F.pmod(key, F.lit(2000)).cast("int")).cast("timestamp_ntz")
    hours = F.pmod(F.col(key) * 7, F.lit(24)).cast("int")
    return day + F.make_dt_interval(hours=hours)


def articles(spark: SparkSession, sf_dir: str, heavy: bool = False, gathered: bool = False) -> DataFrame:
    """Documents as articles; ``heavy`` announces much work per text, ``gathered`` that tasks gather the words of all their texts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    if heavy or gathered:
        documents = spread(documents, "doc_id", most=GATHERED_BYTES if gathered else None)
    return documents.select(
        F.col("doc_id").alias("article_id"),
        _news_time("doc_id").alias("date_utc"),
        F.col("text").alias("Article_title"),
        F.col("source").alias("Stock_symbol"),
    )


def session_articles(spark: SparkSession, sf_dir: str, gathered: bool = False) -> DataFrame:
    return assign_sessions(articles(spark, sf_dir, gathered=gathered), "date_utc", calendar(spark))


def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("ts").cast("timestamp_ntz").alias("date_utc"),
        F.col("props").alias("Article_title"),
        F.col("event_type").alias("Stock_symbol"),
        "user_id",
        "value",
    )


def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored article per embedding: its first three elements are the class logits."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"),
        _news_time("vec_id").alias("date_utc"),
        F.col("embedding").alias("finbert_embedding"),
        softmax(F.slice("embedding", 1, 3)).alias("_p"),
    )
    classes = [F.get("_p", i).alias(f"sent_{c}") for i, c in enumerate(("pos", "neg", "neu"))]
    return rows.select("article_id", "date_utc", "finbert_embedding", *classes)


def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_sessions(scored_articles(spark, sf_dir), "date_utc", calendar(spark))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: exact picks only, so no sum depends on row order."""
    by_key = F.col("o_orderkey")
    bars = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")
    )
    return bars.agg(
        F.min_by("o_totalprice", by_key).alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", by_key).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with ties for every labelled document."""
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(100.0)
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), score.alias("probability"))
    return rows.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def letter_scorer():
    """A deterministic scorer: logits and a small embedding from letter shares of the whole text."""

    def score(texts: list[str]):
        shares = np.array([[t.count(ch) / (len(t) + 1.0) for ch in "aeio"] for t in texts])
        return shares, shares[:, :3] * 10.0

    return score
