"""Calendar, session assignment and as-of joins."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions import timefn
from tidewire.operators.calendar import calendar_for, exchange_holidays, session_lookup, trading_calendar
from tidewire.operators.daily import session_text
from tidewire.operators.order import running_totals, score_cells, with_position, with_row_id
from tidewire.operators.sessions import SESSION, asof_join, assign_sessions, next_trading_date

ARTICLES = "date_utc timestamp_ntz, Article_title string"
JUNE = (date(2020, 5, 25), date(2020, 6, 20))


def counts(df):
    return {str(r[0]): r[1] for r in df.groupBy(SESSION).count().collect()}


def at(day, hour, minute=0, second=0):
    return datetime(2020, 6, day, hour, minute, second)


def frame(spark, times):
    return spark.createDataFrame([(t, f"t{i}") for i, t in enumerate(times)], ARTICLES)


def test_first_variant(spark):
    times = [at(1, 14, 30), at(1, 9, 15), at(1, 16, 45), at(5, 17, 20), at(6, 10), at(7, 15, 30), at(8, 8, 45), at(9, 17, 10)]
    placed = assign_sessions(frame(spark, times))
    assert counts(placed) == {"2020-06-01": 3, "2020-06-05": 1, "2020-06-08": 3, "2020-06-09": 1}


def test_second_variant(spark):
    times = [at(1, 14, 30), at(1, 9, 15), at(1, 20, 45), at(5, 17, 20), at(6, 10), at(7, 15, 30), at(8, 8, 45), at(9, 21, 10)]
    placed = assign_sessions(frame(spark, times), calendar=trading_calendar(spark, *JUNE))
    assert counts(placed) == {"2020-06-01": 2, "2020-06-02": 1, "2020-06-05": 1, "2020-06-08": 3, "2020-06-10": 1}


def test_cutoff_edges(spark):
    rows = frame(spark, [at(2, 19, 59, 59), at(2, 20), at(5, 20), None])
    placed = assign_sessions(rows, calendar=trading_calendar(spark, *JUNE))
    got = {r["Article_title"]: r[SESSION] for r in placed.collect()}
    assert got == {"t0": date(2020, 6, 2), "t1": date(2020, 6, 3), "t2": date(2020, 6, 8), "t3": None}


def test_local_cutoff_follows_daylight_saving(spark):
    rows = spark.createDataFrame(
        [(datetime(2020, 1, 7, 20, 30), "winter"), (datetime(2020, 6, 2, 20, 30), "summer")], ARTICLES
    )
    calendar = trading_calendar(spark, date(2020, 1, 1), date(2020, 6, 30))
    placed = assign_sessions(rows, calendar=calendar, cutoff_hour=16, zone=timefn.NEW_YORK)
    got = {r["Article_title"]: r[SESSION] for r in placed.collect()}
    assert got == {"winter": date(2020, 1, 7), "summer": date(2020, 6, 3)}


def test_existing_session_passes_through(spark):
    rows = frame(spark, [at(1, 10)]).withColumn(SESSION, F.lit(date(1999, 1, 1)))
    assert assign_sessions(rows) is rows


def test_known_holidays():
    # The exchange's published closing days of some years.
    known = {
        1999: "0101 0118 0215 0402 0531 0705 0906 1125 1224",
        2001: "0101 0115 0219 0413 0528 0704 0903 0911 0912 0913 0914 1122 1225",
        2011: "0117 0221 0422 0530 0704 0905 1124 1226",
        2012: "0102 0116 0220 0406 0528 0704 0903 1029 1030 1122 1225",
        2021: "0101 0118 0215 0402 0531 0705 0906 1125 1224",
        2022: "0117 0221 0415 0530 0620 0704 0905 1124 1226",
        2024: "0101 0115 0219 0329 0527 0619 0704 0902 1128 1225",
    }
    for year, days in known.items():
        assert [d.strftime("%m%d") for d in exchange_holidays(year, year)] == days.split()


def test_calendar_override(spark):
    days = trading_calendar(spark, date(2024, 1, 1), date(2024, 1, 7), [date(2024, 1, 3)])
    assert [r[0].day for r in days.orderBy("trading_date").collect()] == [1, 2, 4, 5]
    closed = spark.createDataFrame([(date(2024, 1, 4),)], "d date")
    days = trading_calendar(spark, date(2024, 1, 1), date(2024, 1, 7), closed)
    assert [r[0].day for r in days.orderBy("trading_date").collect()] == [1, 2, 3, 5]


def test_lookup_has_one_row_per_day(spark):
    lookup = session_lookup(trading_calendar(spark, date(2001, 1, 1), date(2001, 12, 31)))
    rows = lookup.collect()
    assert len({r["day"] for r in rows}) == len(rows)
    assert all(r["trading_date"] >= r["day"] for r in rows)
    assert {r["day"]: r["trading_date"] for r in rows}[date(2001, 9, 11)] == date(2001, 9, 17)


def test_sessions_are_trading_days_not_before_the_candidate(spark):
    rng = random.Random(1)
    times = [datetime(1998, 1, 1) + timedelta(minutes=rng.randrange(3 * 365 * 1440)) for _ in range(500)]
    rows = frame(spark, times).withColumn("candidate", timefn.candidate_session("date_utc"))
    calendar = calendar_for(rows)
    placed = assign_sessions(rows, calendar=calendar)
    assert placed.where(F.col(SESSION) < F.col("candidate")).count() == 0
    assert placed.where(F.col(SESSION).isNull()).count() == 0
    assert placed.join(calendar, F.col(SESSION) == F.col("trading_date"), "left_anti").count() == 0


def test_no_later_trading_day_gives_null(spark):
    days = spark.createDataFrame([(date(2020, 6, 19),), (date(2020, 6, 20),)], "d date")
    got = {r["d"]: r["s"] for r in next_trading_date(days, "d", trading_calendar(spark, *JUNE), "s").collect()}
    assert got == {date(2020, 6, 19): date(2020, 6, 19), date(2020, 6, 20): None}


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "year"])
def test_asof_with_a_hot_key_equals_brute_force(spark, direction, bucket):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)

    def some(n):
        # key 0 holds two thirds of the rows, and some times occur often
        return [
            (0 if rng.random() < 0.67 else rng.randrange(1, 5), start + timedelta(minutes=rng.randrange(4000)), i)
            for i in range(n)
        ]

    left, right = some(600), some(200)
    left.append((0, None, 600))
    left_df = spark.createDataFrame(left, "k int, t timestamp_ntz, id int")
    right_df = spark.createDataFrame(right, "k int, t timestamp_ntz, v int")
    got = {r["id"]: (r["matched_t"], r["v"]) for r in asof_join(left_df, right_df, "t", "k", ["v"], direction, bucket).collect()}
    for k, t, i in left:
        hits = [(rt, v) for rk, rt, v in right if rk == k and t is not None and (rt <= t if direction == "backward" else rt >= t)]
        best = None
        if hits:
            time = max(h[0] for h in hits) if direction == "backward" else min(h[0] for h in hits)
            best = (time, max(v for rt, v in hits if rt == time))
        assert got[i] == (best or (None, None))
    assert len(got) == len(left)


def test_asof_rejects_unknown_direction(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), 1)], "k int, t timestamp_ntz, v int")
    with pytest.raises(ValueError):
        asof_join(df, df, "t", "k", ["v"], "nearest")


def test_session_text_in_parts_keeps_every_title(spark):
    titles = [(date(2024, 1, 2), datetime(2024, 1, 2, 10), i, f"title{i}") for i in range(200)]
    titles += [(date(2024, 1, 3), datetime(2024, 1, 3, 10, i), 300 + i, t) for i, t in enumerate(["b", None, "a"])]
    titles += [(date(2024, 1, 4), datetime(2024, 1, 4), 400, None)]
    df = spark.createDataFrame(titles, f"{SESSION} date, date_utc timestamp_ntz, article_id int, Article_title string")
    rows = session_text(df, max_chars=200).collect()
    hot = [r for r in rows if r[SESSION] == date(2024, 1, 2)]
    assert len(hot) > 3
    assert sorted(t for r in hot for t in r["daily_text"].split(" ")) == sorted(f"title{i}" for i in range(200))
    assert all(r["daily_text"].split(" ") == sorted(r["daily_text"].split(" "), key=lambda t: int(t[5:])) for r in hot)
    rest = {(r[SESSION].day, r["part"]): r["daily_text"] for r in rows if r[SESSION] != date(2024, 1, 2)}
    assert rest == {(3, 0): "b a", (4, 0): ""}
    whole = {r[SESSION].day: r["daily_text"] for r in session_text(df).collect()}
    assert whole[2] == " ".join(f"title{i}" for i in range(200))


def test_session_text_parts_in_order_are_the_text(spark):
    titles = [(date(2024, 1, 2 + i % 2), datetime(2024, 1, 2, i % 7), i, None if i % 50 == 9 else f"title{i}") for i in range(400)]
    df = spark.createDataFrame(titles, f"{SESSION} date, date_utc timestamp_ntz, article_id int, Article_title string").repartition(5)
    whole = {r[SESSION]: r["daily_text"] for r in session_text(df).collect()}
    for most in (1, 100, 700):
        parts = session_text(df, max_chars=most).orderBy(SESSION, "part").collect()
        assert len(parts) > 4 - 2 * (most == 700)
        for day, text in whole.items():
            assert " ".join(r["daily_text"] for r in parts if r[SESSION] == day and r["daily_text"]) == text


def test_positions_equal_brute_force(spark):
    rng = random.Random(3)
    days = [date(2024, 1, 1) + timedelta(days=d) for d in range(20)]
    keys = [(d, f"t{i:03d}") for d in days for i in range(40 if d == days[5] else rng.randrange(0, 4))]
    shuffled = rng.sample(keys, len(keys))
    df = spark.createDataFrame(shuffled, "d date, k string")
    expected = {key: i for i, key in enumerate(sorted(keys))}
    assert {(r["d"], r["k"]): r["position"] for r in with_position(df, "d", "k").collect()} == expected
    assert {(r["d"], r["k"]): r["id"] for r in with_row_id(df, ["d", "k"]).collect()} == expected


def test_running_totals_with_crowded_scores(spark):
    rng = random.Random(5)
    scores = {rng.random() for _ in range(100)} | {0.5 + rng.random() * 1e-7 for _ in range(200)}
    scores |= {0.0, 1.0, -3.5, 17.0, 1e9, -1e9, 2e9}
    rows = [(s, rng.randrange(5)) for s in scores]
    df = spark.createDataFrame(rows, "s double, v int")
    got = {r["s"]: r["v_before"] for r in running_totals(df, "s", ["v"], score_cells("s")).collect()}
    total = 0
    for s, v in sorted(rows):
        assert got[s] == total
        total += v


def test_days_long_before_the_calendar_have_its_first_date(spark):
    calendar = trading_calendar(spark, date(2024, 2, 1), date(2024, 2, 29))
    rows = [(1, "2001-05-05 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-02-03 10:00:00"), (4, None)]
    df = spark.createDataFrame(rows, "id int, date_utc string").selectExpr("id", "cast(date_utc as timestamp_ntz) date_utc")
    got = {r.id: r[2] for r in assign_sessions(df, calendar=calendar).collect()}
    assert got == {1: date(2024, 2, 1), 2: date(2024, 2, 1), 3: date(2024, 2, 5), 4: None}
