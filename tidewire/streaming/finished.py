"""Daily sentiment appended once per session, when the session is over, with an account of what came too late.

The stream keeps running sums per open session and a watermark on the sessions' closing times. When the watermark has
passed a session, its row is appended to the sink and its state is dropped, so state holds open sessions only. Articles that
arrive for a session after that are not in its row; the partial sums of ``incremental``, which take every article, tell how
many they are and what they would have changed.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.sessions import SESSION, assign_sessions
from tidewire.streaming.incremental import CLASSES, PARTIAL_SCHEMA, update_daily_sentiment

FINISHED_SCHEMA = f"{SESSION} date, sum_pos double, sum_neg double, sum_neu double, articles long"


def finished_sessions(stream: DataFrame, calendar: DataFrame, delay: str, cutoff_hour: int = 20) -> DataFrame:
    """The stream of sessions that are over: sums and count of their articles, each session once.

    A session is over when the watermark, ``delay`` behind the closing time of the latest session seen, has reached its
    own closing time.
    """
    rows = assign_sessions(stream, "date_utc", calendar, cutoff_hour).where(F.col(SESSION).isNotNull())
    close = (F.col(SESSION).cast("timestamp") + F.make_dt_interval(hours=F.lit(cutoff_hour))).alias("_close")
    rows = rows.select(SESSION, close, *(f"sent_{c}" for c in CLASSES)).withWatermark("_close", delay)
    sums = [F.sum(f"sent_{c}").alias(f"sum_{c}") for c in CLASSES]
    return rows.groupBy("_close", SESSION).agg(*sums, F.count(F.lit(1)).alias("articles")).drop("_close")


def run_sessions(stream: DataFrame, calendar: DataFrame, folder: str, delay: str = "3 days", cutoff_hour: int = 20) -> None:
    """Work through the files at hand: sessions that are over to ``folder/finished``, all articles to ``folder/partials``.

    Both queries have checkpoints, so a restart goes on where they stopped and no article or session counts twice.
    """
    query = (
        finished_sessions(stream, calendar, delay, cutoff_hour)
        .writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint-finished").option("path", f"{folder}/finished")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    update_daily_sentiment(stream, calendar, f"{folder}/partials", f"{folder}/checkpoint-partials", cutoff_hour)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except PySparkException:
        return spark.createDataFrame([], schema)


def _arrived(spark: SparkSession, folder: str) -> DataFrame:
    parts = _read(spark, f"{folder}/partials", PARTIAL_SCHEMA)
    sums = [F.sum(f"sum_{c}").alias(f"all_{c}") for c in CLASSES]
    return parts.groupBy(SESSION).agg(*sums, F.sum("articles").alias("all_articles"))


def session_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Means and article count of every session seen, and whether it is ``finished``; open ones are as of now.

    A finished session's row never changes again.
    """
    finished = _read(spark, f"{folder}/finished", FINISHED_SCHEMA).withColumn("finished", F.lit(True))
    arrived = _arrived(spark, folder).where(F.col(SESSION).isNotNull())
    open_ = arrived.join(finished.select(SESSION), SESSION, "left_anti")
    open_ = open_.select(SESSION, *(F.col(f"all_{c}").alias(f"sum_{c}") for c in CLASSES), F.col("all_articles").alias("articles"), F.lit(False).alias("finished"))
    rows = finished.unionByName(open_)
    means = [(F.col(f"sum_{c}") / F.col("articles")).alias(f"avg_{c}") for c in CLASSES]
    return rows.select(SESSION, *means, F.col("articles").alias("daily_article_count"), "finished")


def late_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The side table: finished sessions with articles that came after their end, how many (``late``), and the sums they hold."""
    finished = _read(spark, f"{folder}/finished", FINISHED_SCHEMA)
    both = finished.join(_arrived(spark, folder), SESSION)
    late = (F.col("all_articles") - F.col("articles")).alias("late")
    return both.select(SESSION, late, *((F.col(f"all_{c}") - F.col(f"sum_{c}")).alias(f"late_{c}") for c in CLASSES)).where("late > 0")
