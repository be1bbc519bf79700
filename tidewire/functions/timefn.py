"""Time columns.

Instants are kept as ``TIMESTAMP_NTZ`` holding the UTC wall clock, so no result
depends on the session time zone.  ``date_trunc`` and ``date_format`` are avoided: they
pass through that zone, and would shift times its daylight saving skips.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_utc(c: Column | str) -> Column:
    """``2020-01-31 12:00:00 UTC`` to a timestamp; anything else becomes null."""
    c = as_column(c)
    shape = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC$"
    return F.when(c.rlike(shape), c.substr(1, 19).try_cast("timestamp_ntz"))


def format_utc(c: Column | str) -> Column:
    """Inverse of :func:`parse_utc`; fractions of a second are cut off."""
    return F.concat(as_column(c).cast("timestamp_ntz").cast("string").substr(1, 19), F.lit(" UTC"))


def parse_date(c: Column | str, strict: bool = True) -> Column:
    """``2020-01-31`` to a date; bad text raises, or gives null if not strict."""
    c = as_column(c)
    if strict:
        return F.to_date(c, "yyyy-MM-dd")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def attach_utc(c: Column | str) -> Column:
    """Read a naive or zoned timestamp as UTC wall clock."""
    return as_column(c).cast("timestamp_ntz")


def to_zone(c: Column | str, zone: str = NEW_YORK) -> Column:
    """UTC wall clock to the wall clock of ``zone``, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_column(c))


def is_not_midnight(c: Column | str) -> Column:
    c = as_column(c)
    return c != F.to_date(c).cast("timestamp_ntz")


def time_bucket(c: Column | str, unit: str) -> Column:
    """The calendar unit a time falls into, as a value that sorts like the time."""
    c = as_column(c)
    day = F.to_date(c)
    parts = {
        "year": [F.year(c)],
        "month": [F.year(c), F.month(c)],
        "day": [day],
        "hour": [day, F.hour(c)],
        "minute": [day, F.hour(c), F.minute(c)],
    }
    if unit not in parts:
        raise ValueError(f"unknown unit: {unit}")
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts[unit])])


def candidate_session(c: Column | str, cutoff_hour: int = 20, zone: str | None = None) -> Column:
    """The first date an article may count for.

    Before the cutoff it is the article's own date, from the cutoff on the next
    date.  The hour is read in UTC, or in ``zone`` if one is given.
    """
    c = as_column(c)
    local = to_zone(c, zone) if zone else c
    day = F.to_date(local)
    return F.when(F.hour(local) < cutoff_hour, day).when(local.isNotNull(), F.date_add(day, 1))
