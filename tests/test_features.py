import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import features

from conftest import day

T = "2021-12-01"


def back(n):
    return (day(T) - dt.timedelta(n)).isoformat()


@pytest.fixture(scope="module")
def weekdays(make):
    return make.weekdays("2021-10-01", "2022-04-30", holidays=("2021-11-19",))


def closed(start, end):
    days = [start + dt.timedelta(n) for n in range((end - start).days + 1)]
    return sum(1 for d in days if d.weekday() >= 5 or d.isoformat() == "2021-11-19")


def gap(start, end):
    return (end - start).days - 1 - closed(start, end)


def test_stats_window_holds_both_ends(make):
    rows = [(1, T, "EQ", 2, 10.0), (1, T, "FUT", 3, 20.0), (1, back(30), "EQ", 5, 30.0), (1, back(31), "EQ", 7, 99.0),
            (1, back(3), "EQ", 1, None), (1, back(2), "EQ", 1, 40.0)]
    row = features.cohort_trade_stats(make.trades(rows), make.kyc([1]), days=[T]).first()
    assert (row.trade_days_cnt, row.total_trades, row.total_order_count, row.avg_investment) == (4, 5, 12, 25.0)
    assert features.cohort_trade_stats(make.trades(rows), make.kyc([1]), days=[T], max_days=3, min_days=None).isEmpty()


def test_next_trade_default_and_future_rule(make, weekdays):
    rows = [(p, T) for p in (1, 2, 3)] + [(1, "2021-12-08"), (3, "2022-02-01")] + [(2, f"2021-12-{d}") for d in (14, 15, 16, 17)]
    rows.append((3, "2022-01-31"))
    trades = make.trades(rows)
    def targets(**options):
        found = features.next_trade_target(trades, make.kyc([1, 2, 3]), weekdays, days=[T], **options).collect()
        return {r.party_code: r for r in found}
    loose, strict = targets(), targets(min_future_days=4)
    assert str(loose[1].next_trade) == "2021-12-08" and loose[1].inactive_days == gap(day(T), day("2021-12-08"))
    assert str(loose[3].next_trade) == "2022-01-31"  # T + 61 is the last day seen
    default = day(T) + dt.timedelta(65)
    assert strict[1].next_trade == default and str(strict[2].next_trade) == "2021-12-14"
    inside = closed(day(T), day(T) + dt.timedelta(60))  # closed days count up to T + 60 only
    assert strict[1].inactive_days == 64 - inside


def expected_recency(dates):
    """Gaps computed from the definition with plain date arithmetic."""
    anchor, start = day(T), day(T) - dt.timedelta(30)
    seen = sorted({d for d in dates if start <= d <= anchor}, reverse=True)
    chain, missing = [anchor], []
    for step in (1, 2, 3):
        known = len(seen) > step
        chain.append(seen[step] if known else start)
        missing.append(not known)
    gaps = [gap(chain[i + 1], chain[i]) for i in range(3)]
    gaps[1] += 30 if missing[1] else 0
    gaps[2] += 60 if missing[2] else 0
    return gaps


@pytest.mark.parametrize("earlier", [[], [3], [3, 9], [3, 9, 20], [1, 2, 5, 6, 29], [30, 31], [2, 4, 40]])
def test_recency_with_missing_days(make, weekdays, earlier):
    dates = [day(T)] + [day(T) - dt.timedelta(n) for n in earlier]
    trades = make.trades([(1, d.isoformat()) for d in dates] + [(1, T)])
    row = features.recency_features(trades, weekdays, days=[T]).first()
    gaps = expected_recency(dates)
    assert [row.gap_1, row.gap_2, row.gap_3] == gaps
    assert row.mean_last_3 == pytest.approx(sum(gaps) / 3)
    assert row.stddev_last_3 == pytest.approx(statistics.stdev(gaps))


def test_week_cohort_anchor_and_windows(make):
    week = "2021-11-29"
    rows = [(1, d) for d in ("2021-11-10", "2021-11-12", "2021-11-16", "2021-11-29", "2021-12-01", "2021-12-03")]
    rows += [(1, "2021-12-08"), (2, "2021-12-04"), (2, "2021-11-10"), (2, "2021-11-11"), (2, "2021-11-12"), (2, "2021-11-15")]
    calendar = make.weekdays("2021-10-01", "2022-04-30")
    found = features.week_cohort(make.trades(rows), make.kyc([1, 2]), calendar, weeks=[week]).collect()
    assert [r.party_code for r in found] == [1]  # party 2 trades on Saturday only, outside the five days
    row = found[0]
    assert (str(row.anchor), row.trade_days_cnt, str(row.next_trade)) == ("2021-12-03", 4, "2021-12-08")
    assert (row.gap_1, row.gap_2, row.gap_3) == (1, 1, 8)
    assert row.inactive_days == 2
    every = features.week_cohort(make.trades(rows), make.kyc([1, 2]), calendar)
    assert every.filter(F.col("week_start") == week).collect() == found


def test_demographics(make):
    kyc = make.kyc(
        [
            {"party_code": 1, "B2C": "Y", "gender": "f", "riskcategory": "HIGH", "incomedetails": ">25 LAC",
             "occupation": "Business", "birthdate": day("1986-12-10"), "activefrom": day("2021-11-01"), "City": "NEW DELHI"},
            {"party_code": 2, "B2C": "Y", "gender": "M", "City": "nowhere", "birthdate": day("1985-12-01")},
            {"party_code": 3, "B2C": "Y"},
        ]
    )
    tiers = make.tiers([("New delhi", "Tier-I"), ("New Delhi", "Tier-II"), ("Nowhere", None)])
    rows = {r.party_code: r for r in features.demographic_features(kyc, tiers, T).collect()}
    one, two, three = rows[1], rows[2], rows[3]
    assert (one.Tier, one.gender_f, one.riskcategory_new, one.new_incomedetails, one.new_age) == ("Tier-I", 1, 2, 5, 1)
    assert one.activeinsys == 30 and one.age > 0
    assert (two.Tier, two.gender_f, two.riskcategory, two.occupation, two.new_age) == ("Tier-III", 0, "other", "other", 2)
    assert (three.Tier, three.new_age, three.new_incomedetails) == ("Tier-III", 3, 0)


def test_last_listed_tier_wins(make, spark):
    tiers = spark.createDataFrame([("Pune", "Tier-I", 1), ("Pune", "Tier-II", 2)], "City string, Tier string, line int")
    assert features.city_tiers(tiers, "line").first().Tier == "Tier-II"


def test_instruments_by_inactivity_keep_duplicates(make, weekdays):
    rows = [(1, T, "EQ"), (1, T, "EQ"), (1, T, "FUT"), (2, T, "EQ")]
    rows += [(1, f"2021-12-{d:02d}") for d in (2, 3, 6, 7)] + [(2, "2021-12-02")]
    found = features.instrument_mix_by_inactivity(make.trades(rows), make.kyc([1, 2]), weekdays, days=[T]).collect()
    assert {(r.bucket, r.INST_TYPE): r.Total for r in found} == {("0-2", "EQ"): 2, ("0-2", "FUT"): 1}
