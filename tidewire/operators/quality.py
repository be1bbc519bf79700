"""Data-quality checks as frames of counts or offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.daily import daily_sentiment
from tidewire.operators.sessions import SESSION
from tidewire.sources.news import in_range


def date_summary(df: DataFrame, ts: str) -> DataFrame:
    """Distinct days (null counts as one), first and last day, span in days."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    low, high = F.min("day"), F.max("day")
    return days.agg(
        F.count(F.lit(1)).alias("distinct_days"),
        low.alias("min_date"),
        high.alias("max_date"),
        F.datediff(high, low).alias("span_days"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )


def extent(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("min_date"), F.max(ts).alias("max_date"), F.count(F.lit(1)).alias("rows"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells"))
    return counted.select(F.inline("cells"), "rows")


def pair_copies(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """One column of two copies side by side, by key."""
    left = a.select(key, F.col(column).alias("left_value"))
    return left.join(b.select(key, F.col(column).alias("right_value")), key)


def compare_copies(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column: rows compared, definite mismatches, nulls on both sides."""
    right = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = a.select(key, *columns).join(right, key)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("compared"),
            F.count_if(F.col(c) != F.col(f"_{c}")).alias("mismatches"),
            F.count_if(F.col(c).isNull()).alias("left_nulls"),
            F.count_if(F.col(f"_{c}").isNull()).alias("right_nulls"),
        )
        for c in columns
    ]
    return joined.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def mismatches(a: DataFrame, b: DataFrame, key: str, column: str, n: int | None = 20) -> DataFrame:
    """The first differing rows by key; ``n=None`` gives all."""
    rows = pair_copies(a, b, key, column).where("left_value <> right_value")
    return rows if n is None else rows.orderBy(key).limit(n)


def common_titles(a: DataFrame, b: DataFrame, title: str = "Article_title") -> DataFrame:
    """Distinct non-null titles present in both."""
    return a.select(title).where(F.col(title).isNotNull()).intersect(b.select(title))


def _digest(title: str) -> Column:
    """Titles may be long: only their SHA-256 is shuffled and compared."""
    return F.sha2(title, 256).alias("_digest")


def title_overlap(a: DataFrame, b: DataFrame, title: str = "Article_title") -> DataFrame:
    """Number of distinct non-null titles present in both."""
    left = a.where(F.col(title).isNotNull()).select(_digest(title))
    return left.intersect(b.select(_digest(title))).agg(F.count(F.lit(1)).alias("same_titles"))


def title_difference(
    a: DataFrame,
    b: DataFrame,
    names: tuple[str, str],
    title: str = "Article_title",
    ts: str = "date_est",
    start=None,
    end=None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of either source whose title the other lacks, inside an inclusive window.

    Row multiplicity is kept; rows without a title are left out.
    """
    a, b = in_range(a, ts, start, end), in_range(b, ts, start, end)

    def only(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        titled = x.where(F.col(title).isNotNull()).select(ts, title, *keep, _digest(title))
        kept = titled.join(y.select(_digest(title)).distinct(), "_digest", "left_anti")
        return kept.drop("_digest").withColumn("source", F.lit(name))

    return only(a, b, names[0]).unionByName(only(b, a, names[1]))


def probability_violations(daily: DataFrame, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """Days whose three class means do not add up to 1."""
    total = F.col("avg_pos") + F.col("avg_neg") + F.col("avg_neu")
    return daily.withColumn("probability_sum", total).where(~F.col("probability_sum").between(low, high))


def count_check(daily: DataFrame, articles: DataFrame, by: str = SESSION) -> DataFrame:
    """Stored article counts against a recount."""
    recount = articles.groupBy(by).agg(F.count(F.lit(1)).alias("recount"))
    return daily.select(by, "daily_article_count").join(recount, by)


def spot_check(daily: DataFrame, articles: DataFrame, day=None, by: str = SESSION) -> DataFrame:
    """Difference between the stored means of one day, or of all, and freshly computed ones."""
    chosen = articles if day is None else articles.where(F.col(by) == F.lit(day))
    fresh = daily_sentiment(chosen, by)
    pairs = daily.alias("d").join(fresh.alias("f"), by)
    gaps = [F.abs(F.col(f"d.avg_{c}") - F.col(f"f.avg_{c}")).alias(f"gap_{c}") for c in ("pos", "neg", "neu")]
    counts = F.abs(F.col("d.daily_article_count") - F.col("f.daily_article_count")).alias("gap_count")
    return pairs.select(by, *gaps, counts)


def score_check(scored: DataFrame, key: str, width: int, vector: str = "finbert_embedding") -> DataFrame:
    """Per article: right width, probabilities adding up to 1, and the leading class."""
    total = F.col("sent_pos") + F.col("sent_neg") + F.col("sent_neu")
    top = F.greatest("sent_pos", "sent_neg", "sent_neu")
    leading = F.when(F.col("sent_pos") == top, "Positive").when(F.col("sent_neg") == top, "Negative")
    return scored.select(
        key,
        (F.size(vector) == width).alias("width_ok"),
        (F.abs(total - 1) <= 1e-5).alias("sum_ok"),
        leading.otherwise("Neutral").alias("leading_class"),
        top.alias("leading_score"),
    )
