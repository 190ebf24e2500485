"""One party holding most of the raw rows changes no result and stays small in the per-party window."""

from pyspark.sql import functions as F

from ledgerlife.operators import base, dtu, features, orders, states

HOT = 20_000


def hot_log(spark):
    """Party 1 trades many times on each of 40 days; parties 2 to 9 once every few days."""
    hot = spark.range(HOT).select(F.lit(1).cast("long").alias("party_code"), (F.col("id") % 40).cast("int").alias("n"))
    rest = spark.range(80).select((F.col("id") % 8 + 2).alias("party_code"), (F.col("id") / 2).cast("int").alias("n"))
    return hot.union(rest).select(
        "party_code",
        F.date_add(F.lit("2021-11-01").cast("date"), F.col("n")).alias("sauda_date"),
        F.lit("EQ").alias("INST_TYPE"),
        F.lit(1).cast("long").alias("OC"),
        F.lit(2.0).alias("T_O"),
        F.lit(0.1).alias("Brokerage"),
    )


def test_hot_party_is_one_row_per_day(spark):
    days = base.party_days(hot_log(spark))
    assert days.filter("party_code = 1").count() == 40


def test_results_hold(spark, make):
    log, kyc = hot_log(spark), make.kyc(list(range(1, 10)))
    row = features.cohort_trade_stats(log, kyc, days=["2021-12-05"]).filter("party_code = 1").first()
    per_day = HOT // 40
    assert (row.trade_days_cnt, row.total_trades, row.total_order_count) == (31, 31 * per_day, 31 * per_day)
    assert row.avg_investment == 2.0
    profile = dtu.dtu_profile(log, kyc).orderBy("sauda_date").first()
    assert profile.type3_pct == 100.0
    last = states.daily_summary(log, {}).filter("party_code = 1").agg(F.max("cumulative_trade_days")).first()[0]
    assert last == 40


def test_raw_rows_are_never_shuffled_by_party_alone(spark, make):
    """Below every exchange keyed by party there is a completed per-day aggregation."""
    log = hot_log(spark)
    plan = dtu.dtu_profile(log, None)._jdf.queryExecution().executedPlan().toString().splitlines()
    party = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(party_code#" in line and "sauda_date" not in line]
    days = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(party_code#" in line and "sauda_date" in line]
    assert len(party) == 1 and len(days) == 1 and party[0] < days[0]
    assert "HashAggregate" in plan[party[0] + 1] and "HashAggregate" in plan[days[0] + 1]


def test_repeated_orders_count_once(spark):
    copies = spark.range(5_000).select(
        F.lit(1).cast("long").alias("straccountid"), F.lit(7).cast("long").alias("strguiorgordid"),
        F.lit("2022-01-01").cast("date").alias("dt"), F.lit("DAY").alias("strordduration"),
        F.lit("CNC").alias("strproduct"), F.lit("MKT").alias("strordertype"), F.lit("B").alias("strtranstype"),
        F.lit("S").alias("strstrategycode"), F.lit("I").alias("strinsttype"), F.lit("EQ").alias("strgroup"),
        F.lit("AAA").alias("strsymbolname"), F.lit("RMS").alias("strrejectionby"),
    )
    row = orders.daily_order_profile(copies).first()
    assert (row.Day_validity, row.rejected_by_cnt, row.underlying_assets_cnt) == (1, 1, 1)
