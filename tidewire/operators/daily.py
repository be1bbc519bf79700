"""Session text, daily sentiment and embeddings, counts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.sessions import SESSION
from tidewire.session import materialise

# Longest text put into one row (characters), well below the 2 GB limit of a value.
MAX_TEXT = 64 * 1024 * 1024


def session_text(
    articles: DataFrame,
    session: str = SESSION,
    text: str = "Article_title",
    order: tuple[str, str] = ("date_utc", "article_id"),
    max_chars: int = MAX_TEXT,
) -> DataFrame:
    """Titles of a session joined by blanks in time order, as ``(session, part, daily_text)``.

    A session is cut in time order: part ``k`` has the titles before which the session has
    ``k`` times ``max_chars`` characters or more, so its parts in order are its text at any
    size, and no row holds more than ``max_chars`` and one title besides blanks.  Nothing is
    left out.

    Characters are added up per session first.  Sessions of one part are gathered in one
    aggregation; larger ones are range-partitioned by session and order, so no task holds
    a whole one.
    """
    rows = articles.select(session, *order, text, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_chars"))
    sizes = rows.groupBy(F.col(session).alias("_s")).agg(F.sum("_chars").alias("_sum"))
    large = materialise(sizes.where(F.col("_sum") > max_chars).select("_s"), "large-sessions")  # dates only
    if not large.limit(1).count():
        return _joined(rows.withColumn("part", F.lit(0)), session, text, order)
    same = F.col(session).eqNullSafe(F.col("_s"))
    plain = rows.join(F.broadcast(large), same, "left_anti").withColumn("part", F.lit(0))
    cut = _with_parts(rows.join(F.broadcast(large), same, "left_semi"), session, order, max_chars)
    return _joined(plain, session, text, order).unionByName(_joined(cut, session, text, order))


def _joined(rows: DataFrame, session: str, text: str, order: tuple[str, str]) -> DataFrame:
    entry = F.when(F.col(text).isNotNull(), F.struct(*order, text))
    listed = F.array_sort(F.collect_list(entry))
    grouped = rows.groupBy(session, "part").agg(listed.alias("_titles"))
    return grouped.select(session, "part", F.array_join(F.col(f"_titles.{text}"), " ").alias("daily_text"))


def _with_parts(rows: DataFrame, session: str, order: tuple[str, str], max_chars: int) -> DataFrame:
    """``rows`` with ``part``, by running sums over slices of the time line of large sessions."""
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # written once: sums and rows must come from the same slices
    rows = materialise(rows.repartitionByRange(slices, session, *order).withColumn("_slice", F.spark_partition_id()), "session-text")
    # one row per slice and session
    sums = rows.groupBy(F.col(session).alias("_s"), F.col("_slice").alias("_of")).agg(F.sum("_chars").alias("_sum"))
    earlier = Window.partitionBy("_s").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_s", "_of", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_slice", session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
    placed = placed.join(F.broadcast(starts), (F.col("_slice") == F.col("_of")) & F.col(session).eqNullSafe(F.col("_s")))
    return placed.withColumn("part", F.floor((F.col("_start") + F.col("_before")) / F.lit(max_chars)).cast("int"))


def daily_sentiment(df: DataFrame, by: str = SESSION) -> DataFrame:
    """Mean of the three class probabilities and the article count per day."""
    means = [F.avg(f"sent_{c}").alias(f"avg_{c}") for c in ("pos", "neg", "neu")]
    return df.groupBy(by).agg(*means, F.count(F.lit(1)).alias("daily_article_count"))


def by_calendar_day(df: DataFrame, ts: str = "date_utc") -> DataFrame:
    """Replace the timestamp by its date, for grouping by calendar day."""
    return df.withColumn(ts, F.to_date(ts))


def _as_vector(column: str) -> Column:
    return array_to_vector(F.transform(column, lambda x: x.cast("double")))


def daily_embedding(df: DataFrame, by: str = SESSION, vector: str = "finbert_embedding") -> DataFrame:
    """Element-wise mean of the vectors of a day, as ``daily_embedding`` of floats.

    One partial aggregation: a task keeps one running mean per day, and only those are
    shuffled, never the article vectors.
    """
    mean = Summarizer.mean(_as_vector(vector))
    rows = df.where(F.col(vector).isNotNull())
    return rows.groupBy(by).agg(vector_to_array(mean, "float32").alias("daily_embedding"))


def article_counts(df: DataFrame, day: str, start=None, end=None) -> DataFrame:
    """Rows per date within an optional inclusive range."""
    counts = df.groupBy(F.to_date(day).alias("day")).agg(F.count(F.lit(1)).alias("article_count"))
    if start is not None:
        counts = counts.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        counts = counts.where(F.col("day") <= F.lit(end).cast("date"))
    return counts


def count_axis_top(counts: DataFrame, count: str = "article_count") -> DataFrame:
    """Upper end of the count axis: a tenth above the highest bar, 1 if there is none."""
    top = F.max(count)
    return counts.agg(F.when(top > 0, top * 1.1).otherwise(1.0).alias("axis_top"))


def merge_sessions(parts: DataFrame, by: str = SESSION) -> DataFrame:
    """Merge daily sentiment computed on separate files: means weighted by article count.

    A session cut by a file boundary appears once again.
    """
    n = F.col("daily_article_count")
    means = [
        (F.sum(F.col(f"avg_{c}") * n) / F.sum(n)).alias(f"avg_{c}") for c in ("pos", "neg", "neu")
    ]
    return parts.groupBy(by).agg(*means, F.sum(n).alias("daily_article_count"))


def merge_embeddings(parts: DataFrame, weight: str = "daily_article_count", by: str = SESSION) -> DataFrame:
    """The same for daily embeddings that carry their article count."""
    mean = Summarizer.mean(_as_vector("daily_embedding"), F.col(weight).cast("double"))
    packed = vector_to_array(mean, "float32").alias("daily_embedding")
    return parts.groupBy(by).agg(packed, F.sum(weight).alias(weight))


def pool_tokens(df: DataFrame, key: str, pos: str, vector: str, mask: str, pooling: str = "mean") -> DataFrame:
    """One vector per text from its token vectors: masked mean, or the first token (``cls``).

    A text without any counted token gets the zero vector.
    """
    if pooling == "cls":
        return df.where(F.col(pos) == 0).select(key, F.col(vector).alias("embedding"))
    if pooling != "mean":
        raise ValueError(f"unknown pooling: {pooling}")
    counted = F.transform(vector, lambda x: x.cast("double") * F.col(mask))
    total = Summarizer.metrics("sum").summary(array_to_vector(counted))["sum"]
    sums = df.groupBy(key).agg(
        vector_to_array(total).alias("_sum"), F.greatest(F.sum(mask).cast("double"), F.lit(1e-9)).alias("_n")
    )
    return sums.select(key, F.transform("_sum", lambda x: x / F.col("_n")).alias("embedding"))


def duplicate_sessions(df: DataFrame, by: str = SESSION) -> DataFrame:
    """Sessions that occur more than once."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Last ``n`` rows under a declared order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
