import re

import pytest
from pyspark.sql import functions as F

from ledgerlife.operators import orders, states
from ledgerlife.sources import schemas

from conftest import day


def lines(spark, rows):
    defaults = dict(
        straccountid=1, strguiorgordid=1, dt="2022-01-01", strordduration="DAY", strproduct="CNC", strordertype="MKT",
        strtranstype="B", strstrategycode="S", strinsttype="I", strgroup="EQ", strsymbolname="AAA", strrejectionby=None,
    )
    full = [{**defaults, **row} for row in rows]
    data = [tuple(day(r[n]) if n == "dt" else r[n] for n in schemas.ORDER_DETAIL.names) for r in full]
    return spark.createDataFrame(data, schemas.ORDER_DETAIL)


def test_profile_counts_distinct_rows_and_skips_blanks(spark):
    detail = lines(
        spark,
        [
            {}, {},  # the same row twice
            {"strguiorgordid": 2, "strgroup": "BT", "strsymbolname": "", "strrejectionby": "RMS", "strtranstype": "S"},
            {"strguiorgordid": 3, "strgroup": None, "strsymbolname": None, "strrejectionby": "", "strproduct": "MIS"},
            {"strguiorgordid": 4, "strgroup": "XX", "strordduration": "IOC", "strrejectionby": "RMS"},
            {"strguiorgordid": 5, "dt": "2021-12-01"},
        ],
    )
    row = orders.daily_order_profile(detail, since="2022-01-01").collect()
    assert len(row) == 1
    row = row[0]
    assert (row.Day_validity, row.Immediate_or_Cancel, row.Delivery_cash, row.Margin_intraday) == (3, 1, 3, 1)
    assert (row.Buy, row.Sell, row.No_group, row.Special_eq) == (3, 1, 1, 1)
    assert (row.rejected_by_cnt, row.underlying_assets_cnt) == (2, 1)


def test_order_lists_of_nulls_are_empty(spark):
    detail = lines(
        spark,
        [
            {"strsymbolname": None},
            {"straccountid": 2, "strrejectionby": "RMS"},
            {"straccountid": 2, "strguiorgordid": 2, "strrejectionby": "RMS"},
            {"straccountid": 2, "strguiorgordid": 3, "strrejectionby": "", "strsymbolname": ""},
        ],
    )
    rows = {r.party_id: r for r in orders.order_lists(detail).collect()}
    assert (rows[1].assets, rows[1].underlying_assets_cnt, rows[1].rejected_by_cnt) == ([], 0, 0)
    assert (rows[2].assets, rows[2].underlying_assets_cnt, rows[2].rejected_by_cnt) == (["AAA"], 1, 2)
    assert [tuple(item) for item in rows[2].rejections] == [("RMS", 2)]
    sizes = {r.party_id: (r.underlying_assets_cnt, r.rejected_by_cnt) for r in orders.daily_order_profile(detail).collect()}
    assert sizes == {p: (r.underlying_assets_cnt, r.rejected_by_cnt) for p, r in rows.items()}


@pytest.fixture(scope="module")
def mart_parts(make, spark):
    trades = make.trades([(1, "2022-01-01", "EQ"), (1, "2022-01-03"), (1, "2022-01-04"), (2, "2022-01-01"), (2, "2022-01-02")])
    daily = states.daily_summary(trades, {"has_cnc_trade": ["EQ"]})
    targets = states.transition_targets(daily)
    profile = orders.daily_order_profile(lines(spark, [{"straccountid": p, "dt": d} for p, d in
                                                        [(1, "2022-01-01"), (1, "2022-01-03"), (2, "2022-01-01")]]))
    kyc = make.kyc([{"party_code": 1, "B2C": "Y", "gender": "f", "City": "Pune", "birthdate": day("1990-01-01")}, 2])
    return targets, trades, profile, kyc


def test_chained_mart_loses_what_follows_a_miss(mart_parts, make):
    targets, trades, profile, kyc = mart_parts
    turnover = trades.filter("party_code != 1 or sauda_date != '2022-01-03'")

    def mart(chained):
        rows = orders.customer_feature_mart(targets, turnover, profile, kyc, "2022-02-01", chained).collect()
        return {(r.party_code, str(r.sauda_date)): r for r in rows}

    plain, chained = mart(False), mart(True)
    assert len(plain) == len(chained) == 5
    assert (plain[1, "2022-01-03"].T_O, plain[1, "2022-01-03"].Buy, plain[1, "2022-01-03"].gender) == (None, 1, "f")
    assert (chained[1, "2022-01-03"].Buy, chained[1, "2022-01-03"].gender) == (None, None)
    assert plain[1, "2022-01-04"].gender == "f" and chained[1, "2022-01-04"].gender is None
    assert plain[1, "2022-01-01"].has_cnc_trade is True and plain[1, "2022-01-01"].has_mis_trade is False
    assert plain[1, "2022-01-01"].age == pytest.approx(32.11, abs=0.01)


def test_data_sets(mart_parts, make):
    targets, trades, profile, kyc = mart_parts
    mart = orders.customer_feature_mart(targets, trades, profile, kyc, "2022-02-01")
    tiers = make.tiers([("Pune", "Tier-I")])
    settle = orders.settle_dataset(mart, tiers)
    assert settle.count() == 2 and "End_of_Session" not in settle.columns and "party_code" not in settle.columns
    assert {r.Tier for r in settle.collect()} == {"Tier-I", "Tier-III"}
    frequent = orders.frequent_dataset(mart, tiers).collect()
    assert len(frequent) == 2
    one = next(r for r in frequent if r.gender == "F")
    assert (one.T_O, one.Buy, one.frequent_target, one.has_cnc_trade) == (20.0, 1, 0, True)
    other = next(r for r in frequent if r.gender is None)
    assert (other.Buy, other.age) == (0, 0.0)  # nothing to sum counts as zero
    assert orders.settle_dataset(mart, tiers, "2021-12-31").isEmpty()


def busy_lines(spark, parties):
    """Orders of two lines each: a busy party-day of 300 orders, and one order a day for each other party."""
    order = spark.range(2 * (300 + parties)).select((F.col("id") / 2).cast("long").alias("strguiorgordid"), (F.col("id") % 2).alias("line"))
    account = F.when(F.col("strguiorgordid") < 300, 0).otherwise(F.col("strguiorgordid") - 299)
    given = {"straccountid": account, "dt": F.date_add(F.lit("2022-01-01").cast("date"), (F.col("strguiorgordid") / 10_000).cast("int")), "strsymbolname": F.concat(F.lit("S"), F.col("line") + F.col("strguiorgordid") % 5)}
    kinds = {f.name: f.dataType for f in schemas.ORDER_DETAIL}
    return order.select(*[given.get(n, F.col(n) if n == "strguiorgordid" else F.lit("B" if n == "strtranstype" else None)).cast(kinds[n]).alias(n) for n in schemas.ORDER_DETAIL.names])


def test_profile_is_dealt_over_the_given_tasks(spark):
    detail = busy_lines(spark, 2_000)
    dealt = orders.daily_order_profile(detail, tasks=40)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 40 and sum(sizes) == 2_001 and max(sizes) < 100
    assert sorted(dealt.collect()) == sorted(orders.daily_order_profile(detail).collect())
    busy = dealt.filter("party_id = 0").first()
    assert (busy.Buy, busy.underlying_assets_cnt, busy.rejected_by_cnt) == (600, 6, 0)


def test_profile_in_shares_counts_nulls_and_blanks(spark):
    detail = lines(
        spark,
        [{"strguiorgordid": n, "strsymbolname": s, "strrejectionby": "RMS", "straccountid": a}
         for n in range(40) for s in ("AAA", "", None) for a in (1, None)] * 2,
    )
    rows = {r.party_id: (r.Buy, r.rejected_by_cnt, r.underlying_assets_cnt) for r in orders.daily_order_profile(detail, tasks=3).collect()}
    assert rows == {1: (120, 120, 1), None: (120, 120, 1)}


def test_misses_of_the_chain_are_no_common_key(spark, make):
    trades = make.trades([(p, "2022-01-01") for p in range(1, 401)])
    targets = states.transition_targets(states.daily_summary(trades, {}))
    profile = orders.daily_order_profile(lines(spark, [{"straccountid": 1}]))
    kyc = make.kyc([{"party_code": p, "B2C": "Y", "gender": "f"} for p in range(1, 401)])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        mart = orders.customer_feature_mart(targets, trades, profile, kyc, "2022-02-01", chained=True)
        rows = mart.select("party_code", "gender", "T_O", F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    sizes = [sum(r.task == task for r in rows) for task in {r.task for r in rows}]
    assert len(rows) == 400 and max(sizes) < 120
    assert all(r.T_O == 10.0 and r.gender == ("f" if r.party_code == 1 else None) for r in rows)


def test_data_set_steps_are_dealt_over_the_given_tasks(spark, make):
    """Day sums, party windows and distinct customers too: none goes by the session's number of shuffle partitions."""
    days = [(p, f"2022-01-0{d}", code, 1, amount) for p in (1, 2, 3, None) for d in (1, 3, 4) for code, amount in (("EQ", 5.0), ("XX", None), ("EQ", 7.0))]
    trades, kyc = make.trades(days * 2), make.kyc([{"party_code": 1, "B2C": "Y", "gender": "f"}, {"party_code": 1, "B2C": "Y", "gender": "f"}, 2])
    profile = orders.daily_order_profile(lines(spark, [{}]).repartition(7, "strguiorgordid"), tasks=7)

    def mart(tasks):
        stored = spark.createDataFrame(states.daily_summary(trades, {"has_cnc_trade": ["EQ"]}, tasks).collect())
        targets = states.transition_targets(stored, tasks=tasks)
        return stored, orders.customer_feature_mart(targets, trades, profile, kyc, "2022-02-01", tasks=tasks)

    (summary, dealt), (plain_summary, plain) = mart(7), mart(None)
    for df in (states.daily_summary(trades, {"has_cnc_trade": ["EQ"]}, 7), dealt):
        found = re.findall(r"hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
        assert found and set(found) == {"7"}
    assert sorted(map(str, summary.collect())) == sorted(map(str, plain_summary.collect()))
    rows = dealt.collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain.collect()))
    # A null party joins nothing.
    assert {(r.party_code, r.T_O, r.has_cnc_trade) for r in rows} == {(p, p and 24.0, True) for p in (1, 2, 3, None)}
