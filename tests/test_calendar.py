import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import calendar

from conftest import day


def closed_set(open_days, first, last):
    span = (last - first).days
    return {first + dt.timedelta(n) for n in range(span + 1)} - set(open_days)


def expected_gap(start, end, closed):
    inside = sum(1 for d in closed if start <= d <= end)
    return (end - start).days - 1 - inside


def test_gap_equals_set_counting_on_random_intervals(spark, make):
    rng = random.Random(5)
    first = dt.date(2021, 1, 1)
    open_days = [first + dt.timedelta(n) for n in range(200) if rng.random() < 0.7]
    pairs = []
    for _ in range(300):
        a = first + dt.timedelta(rng.randrange(-20, 230))
        pairs.append((a, a + dt.timedelta(rng.randrange(0, 60))))
    frame = spark.createDataFrame(pairs, "a date, b date")
    found = calendar.business_days_between(frame, "a", "b", make.calendar(open_days)).collect()
    closed = closed_set(open_days, dt.date(2020, 11, 1), dt.date(2022, 1, 1))
    for row in found:
        assert row.business_days == expected_gap(row.a, row.b, closed), row


def test_closed_days_count_only_inside_the_window(spark, make):
    open_days = make.weekdays("2021-11-01", "2022-02-28")
    frame = spark.createDataFrame([(day("2021-12-01"), day("2022-02-04"))], "a date, b date")
    row = calendar.business_days_between(frame, "a", "b", open_days, "2021-12-01", "2022-01-30").first()
    weekend = closed_set(
        [d.TradingDay for d in open_days.collect()], dt.date(2021, 12, 1), dt.date(2022, 1, 30)
    )
    assert row.business_days == (day("2022-02-04") - day("2021-12-01")).days - 1 - len(weekend)


@pytest.mark.parametrize(
    "start,end,expected",
    [
        ("2021-12-06", "2021-12-10", 2),  # Monday to Friday with the holiday between
        ("2021-12-08", "2021-12-10", 0),  # holiday on the start day is counted away too
        ("2021-12-07", "2021-12-09", 0),  # holiday inside
        ("2021-12-06", "2021-12-08", 0),  # holiday on the end day
        ("2021-12-09", "2021-12-09", -1),  # the same day
    ],
)
def test_holiday_edges(spark, make, start, end, expected):
    open_days = make.weekdays("2021-12-01", "2021-12-31", holidays=("2021-12-08",))
    frame = spark.createDataFrame([(day(start), day(end))], "a date, b date")
    assert calendar.business_days_between(frame, "a", "b", open_days).first().business_days == expected


def test_closed_days_and_checks(spark, make):
    open_days = make.weekdays("2021-12-01", "2021-12-31")
    closed = {r.day.isoformat() for r in calendar.closed_days(open_days, "2021-12-03", "2021-12-06").collect()}
    assert closed == {"2021-12-04", "2021-12-05"}
    asked = spark.createDataFrame([(day("2021-12-04"),), (day("2021-12-06"),)], "day date")
    flags = {r.day.isoformat(): r.is_trading_day for r in calendar.check_trading_days(asked, open_days).collect()}
    assert flags == {"2021-12-04": False, "2021-12-06": True}
    calendar.require_trading_day(open_days, "2021-12-06")
    with pytest.raises(ValueError):
        calendar.require_trading_day(open_days, "2021-12-04")


def test_date_range_includes_both_ends(spark):
    days = calendar.date_range(spark, "2021-02-27", "2021-03-01").agg(F.count("*"), F.max("day")).first()
    assert tuple(days) == (3, day("2021-03-01"))
