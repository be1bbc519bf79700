"""Daily sentiment kept up to date from a stream of scored articles."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.sessions import SESSION, assign_sessions

CLASSES = ("pos", "neg", "neu")
PARTIAL_SCHEMA = f"{SESSION} date, sum_pos double, sum_neg double, sum_neu double, articles long, batch long"


def partial_sums(batch: DataFrame) -> DataFrame:
    """Sums and count per session of one micro-batch."""
    sums = [F.sum(f"sent_{c}").alias(f"sum_{c}") for c in CLASSES]
    return batch.groupBy(SESSION).agg(*sums, F.count(F.lit(1)).alias("articles"))


def update_daily_sentiment(
    stream: DataFrame, calendar: DataFrame, target: str, checkpoint: str, cutoff_hour: int = 20
) -> None:
    """Add the files at hand to the partial sums in ``target``.

    Each micro-batch writes its own folder, overwritten if the batch is repeated
    after a failure, so every article counts once.  There is no state to grow and no
    watermark: late articles are added like any other.
    """

    def write(batch: DataFrame, number: int) -> None:
        sessions = assign_sessions(batch, "date_utc", calendar, cutoff_hour)
        partial_sums(sessions).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_daily_sentiment(spark: SparkSession, target: str) -> DataFrame:
    """Merge the partial sums: equal to the batch aggregation over all articles."""
    try:
        parts = spark.read.schema(PARTIAL_SCHEMA).parquet(target)
    except PySparkException:
        parts = spark.createDataFrame([], PARTIAL_SCHEMA)
    total = F.sum("articles")
    means = [(F.sum(f"sum_{c}") / total).alias(f"avg_{c}") for c in CLASSES]
    return parts.groupBy(SESSION).agg(*means, total.alias("daily_article_count"))
