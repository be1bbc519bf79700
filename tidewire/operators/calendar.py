"""Exchange calendar by rule, and the day-to-session lookup."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Days the New York exchange closed outside the yearly rules.
SPECIAL_CLOSURES = [
    date(1994, 4, 27),
    date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14),
    date(2004, 6, 11),
    date(2007, 1, 2),
    date(2012, 10, 29), date(2012, 10, 30),
    date(2018, 12, 5),
    date(2025, 1, 9),
]


def _easter(year: int) -> date:
    """Gregorian Easter Sunday (Gauss's rule in its anonymous form)."""
    golden = year % 19
    century, rest = divmod(year, 100)
    leap_skips = century - century // 4 - (8 * century + 13) // 25
    moon = (leap_skips + 19 * golden + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    offset = moon - weekday
    return date(year, 3, 28) + timedelta(days=offset)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th given weekday of a month (Monday is 0); n = -1 means the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def _observed(day: date) -> date:
    """Saturday holidays move to Friday, Sunday holidays to Monday."""
    return day + timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def exchange_holidays(first_year: int, last_year: int) -> list[date]:
    """Weekdays without trading on the New York exchange."""
    days: list[date] = []
    for year in range(first_year, last_year + 1):
        new_year = date(year, 1, 1)
        if new_year.weekday() != 5:  # a Saturday New Year is not made up for
            days.append(_observed(new_year))
        if year >= 1998:
            days.append(_nth(year, 1, 0, 3))
        days.append(_nth(year, 2, 0, 3))
        days.append(_easter(year) - timedelta(days=2))
        days.append(_nth(year, 5, 0, -1))
        if year >= 2022:
            days.append(_observed(date(year, 6, 19)))
        days.append(_observed(date(year, 7, 4)))
        days.append(_nth(year, 9, 0, 1))
        days.append(_nth(year, 11, 3, 4))
        days.append(_observed(date(year, 12, 25)))
    days += [d for d in SPECIAL_CLOSURES if first_year <= d.year <= last_year]
    return sorted(d for d in set(days) if d.weekday() < 5)


def trading_calendar(
    spark: SparkSession, start: date, end: date, holidays: Iterable[date] | DataFrame | None = None
) -> DataFrame:
    """Trading days from ``start`` to ``end`` as ``trading_date``.

    ``holidays`` replaces the built-in rules: a list of dates or a one-column frame.
    """
    days = spark.range(0, (end - start).days + 1, 1, 1)
    days = days.select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("trading_date"))
    weekdays = days.where(F.weekday("trading_date") < 5)
    if isinstance(holidays, DataFrame):
        return weekdays.join(holidays.toDF("trading_date"), "trading_date", "left_anti")
    closed = list(holidays) if holidays is not None else exchange_holidays(start.year, end.year)
    listed = ", ".join(f"DATE'{d}'" for d in closed)
    return weekdays.where(f"trading_date NOT IN ({listed})") if closed else weekdays


def calendar_for(df: DataFrame, ts: str = "date_utc", before: int = 5, after: int = 10) -> DataFrame:
    """A calendar around the dates of ``df``; one small job finds their bounds."""
    low, high = df.agg(F.min(ts).cast("date"), F.max(ts).cast("date")).first()
    if low is None:
        low = high = date(2000, 1, 3)
    return trading_calendar(df.sparkSession, low - timedelta(days=before), high + timedelta(days=after))


def session_lookup(calendar: DataFrame, lead_days: int = 10) -> DataFrame:
    """Each calendar day with the first trading day on or after it, one row per day.

    ``lead_days`` days before the first trading day are covered too.  The ordered
    window runs over the calendar itself, never over data.
    """
    trading = calendar.select("trading_date").where(F.col("trading_date").isNotNull()).distinct()
    previous = F.lag("trading_date").over(Window.orderBy("trading_date"))
    first_day = F.coalesce(F.date_add(previous, 1), F.date_sub("trading_date", lead_days))
    spans = trading.select("trading_date", first_day.alias("first_day"))
    return spans.select(F.explode(F.sequence("first_day", "trading_date")).alias("day"), "trading_date")
