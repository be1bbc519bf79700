"""Assigning articles to trading sessions, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.timefn import candidate_session, time_bucket
from tidewire.operators.calendar import calendar_for, session_lookup

SESSION = "trading_session_date_utc"


def next_trading_date(df: DataFrame, day: str, calendar: DataFrame, name: str = SESSION) -> DataFrame:
    """Forward as-of join on dates: the first trading date on or after ``day``.

    Dates are discrete, so the join is an equality join with a lookup of one row
    per calendar day; any day before the first trading date has that date.  Every left
    row stays; null, or no later trading date, gives null.
    The lookup is broadcast: a century has 36,525 days, all dates Spark can hold are
    3.7 million, whatever the number of articles.
    """
    lookup = session_lookup(calendar).select(F.col("day").alias("_day"), F.col("trading_date").alias(name))
    first = calendar.agg(F.min("trading_date")).first()[0]
    found = df.join(F.broadcast(lookup), F.col(day) == F.col("_day"), "left").drop("_day")
    return found if first is None else found.withColumn(name, F.when(F.col(day) < F.lit(first), F.lit(first)).otherwise(F.col(name)))


def assign_sessions(
    df: DataFrame,
    ts: str = "date_utc",
    calendar: DataFrame | None = None,
    cutoff_hour: int = 20,
    zone: str | None = None,
    name: str = SESSION,
) -> DataFrame:
    """Add the trading session of each article; frames that have one pass through.

    Without a calendar one is built around the data, which takes a job to find the
    bounds; pass one if they are known.
    """
    if name in df.columns:
        return df
    calendar = calendar_for(df, ts) if calendar is None else calendar
    dated = df.withColumn("_candidate", candidate_session(ts, cutoff_hour, zone))
    return next_trading_date(dated, "_candidate", calendar, name).drop("_candidate")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: str,
    values: Sequence[str],
    direction: str = "backward",
    bucket: str = "hour",
) -> DataFrame:
    """For each left row the nearest right row of the same ``by`` key, equal times included.

    ``values`` are taken from the right side together with its time as ``matched_<on>``.
    If several right rows share key and time, the largest ``values`` win.

    A key may hold any share of the rows: its time line is cut into buckets.  The
    nearest right row outside the bucket comes from a table of one row per key and
    bucket, and only the distinct times of one bucket are ordered together.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    back = direction == "backward"
    pick = F.struct(F.col(on).alias("_t"), *[F.col(v).alias(v) for v in values])
    hits = right.where(F.col(on).isNotNull()).groupBy(by, on).agg(F.max(pick).alias("_hit"))
    times = left.where(F.col(on).isNotNull()).select(by, on).distinct()
    kind = hits.schema["_hit"].dataType

    def order(column: str):
        return F.col(column).asc() if back else F.col(column).desc()

    line = hits.select(by, on, "_hit", F.lit(0).alias("_asked")).unionByName(
        times.select(by, on, F.lit(None).cast(kind).alias("_hit"), F.lit(1).alias("_asked"))
    )
    line = line.withColumn("_bucket", time_bucket(on, bucket))
    inside = Window.partitionBy(by, "_bucket").orderBy(order(on), "_asked").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = line.withColumn("_near", F.last("_hit", ignorenulls=True).over(inside)).where("_asked = 1")

    hit_time = F.when(F.col("_hit").isNotNull(), F.col(on))
    nearest = F.max_by("_hit", hit_time) if back else F.min_by("_hit", hit_time)
    per_bucket = line.groupBy(by, "_bucket").agg(nearest.alias("_edge"))
    earlier = Window.partitionBy(by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(by, "_bucket", F.last("_edge", ignorenulls=True).over(earlier).alias("_far"))

    found = found.join(carried, [by, "_bucket"], "left")
    found = found.select(by, on, F.coalesce("_near", "_far").alias("_found"))
    joined = left.join(found, [by, on], "left")
    taken = [F.col(f"_found.{v}").alias(v) for v in values]
    return joined.select(*left.columns, F.col("_found._t").alias(f"matched_{on}"), *taken)
