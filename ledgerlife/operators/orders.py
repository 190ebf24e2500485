"""Order profile per party-day, the customer feature mart and its two data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlife.functions import codes
from ledgerlife.functions import columns as C
from ledgerlife.operators import base
from ledgerlife.operators.features import kyc_rows, with_tier
from ledgerlife.sources.schemas import ORDER_DETAIL

COUNTERS = [*codes.ORDER_COUNTERS, "Special_eq"]


def order_rows(order_detail: DataFrame, since=None) -> DataFrame:
    """Distinct order rows from a date on. The key holds the order id, so it spreads evenly."""
    rows = order_detail.select(*[c for c in ORDER_DETAIL.names if c != "dt"], F.col("dt").cast("date").alias("dt"))
    return base.dates_between(rows, first=since, column="dt").distinct()


def daily_order_profile(order_detail: DataFrame, since=None, tasks: int | None = None) -> DataFrame:
    """Per party and day: 19 order counters, rejections and distinct underlying assets.

    Only the sizes of the asset set and of the rejection list are used
    downstream, so they are counted and no array is built for a busy party.
    With a number of ``tasks`` both steps of the count are dealt over so many,
    whatever the session's exchanges are set to; a busy party-day is counted
    in shares of its assets first.
    """
    party_day, asset = ["party_id", "sauda_date2"], "strsymbolname"
    group = F.col("strgroup")
    counters = [
        *[F.count_if(F.col(column) == code).alias(name) for name, (column, code) in codes.ORDER_COUNTERS.items()],
        F.count_if(~group.isin(*codes.ORDINARY_GROUPS)).alias("Special_eq"),
        F.count_if(F.col("strrejectionby") != "").alias("rejected_by_cnt"),
    ]
    sums = [F.sum(name).alias(name) for name in [*COUNTERS, "rejected_by_cnt"]]
    rows = order_rows(order_detail, since).withColumnsRenamed({"straccountid": "party_id", "dt": "sauda_date2"})
    if tasks is None:
        by_asset = rows.groupBy(*party_day, asset).agg(*counters)
    else:
        rows = rows.withColumn("_share", F.pmod(F.hash("strguiorgordid"), F.lit(base.SHARES)))
        shares = base.dealt(rows, tasks, *party_day, asset, "_share").groupBy(*party_day, asset, "_share").agg(*counters)
        by_asset = base.dealt(shares, tasks, *party_day).groupBy(*party_day, asset).agg(*sums)
    return by_asset.groupBy(*party_day).agg(*sums, F.count_if(F.col(asset) != "").alias("underlying_assets_cnt"))


def order_lists(order_detail: DataFrame, since=None) -> DataFrame:
    """Per party and day: the set of assets and the list of rejections, blanks removed, with their sizes.

    Repeated rejections are held as (reason, times), so a busy party-day keeps
    one entry per code and not one per order; they are counted before they are
    gathered.
    """
    entry = F.array(
        F.struct(F.lit("asset").alias("kind"), F.col("strsymbolname").alias("value")),
        F.struct(F.lit("rejection").alias("kind"), F.col("strrejectionby").alias("value")),
    )
    counted = (
        order_rows(order_detail, since)
        .select(F.col("straccountid").alias("party_id"), F.col("dt").alias("sauda_date2"), F.inline(entry))
        .groupBy("party_id", "sauda_date2", "kind", "value")
        .agg(F.count("*").alias("times"))
    )
    gathered = counted.groupBy("party_id", "sauda_date2").agg(
        F.collect_list(F.when(F.col("kind") == "asset", F.col("value"))).alias("assets"),
        F.collect_list(F.when(F.col("kind") == "rejection", F.struct("value", "times"))).alias("rejections"),
    )
    assets = C.non_blank(F.col("assets"))
    rejections = F.filter("rejections", lambda item: item["value"] != "")
    times = F.aggregate(rejections, F.lit(0).cast("long"), lambda total, item: total + item["times"])
    return gathered.select(
        "party_id",
        "sauda_date2",
        F.array_sort(assets).alias("assets"),
        F.array_sort(rejections).alias("rejections"),
        C.item_count(assets).alias("underlying_assets_cnt"),
        times.alias("rejected_by_cnt"),
    )


def customer_feature_mart(
    targets: DataFrame, trades: DataFrame, profile: DataFrame, kyc: DataFrame, as_of, chained: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Targets with the day's turnover, order profile and customer attributes.

    Every join is keyed on the target row. ``chained=True`` makes each join
    need a match in the one before it, so that one miss blanks the rest; the
    keys stay those of the row, as all misses would share one key otherwise.
    With a number of ``tasks`` the joins, the day's sums and the distinct customers are dealt over so many.
    """
    day, sums = ["party_code", "sauda_date"], [F.sum(c).alias(c) for c in ("Brokerage", "T_O")]
    if tasks is not None:
        trades = base.dealt(base.in_shares(trades, tasks, day, *sums), tasks, *day)
    turnover = trades.groupBy(F.col("party_code").alias("party_code2"), F.col("sauda_date").alias("sauda_date1")).agg(*sums)
    person = kyc_rows(base.dealt(kyc, tasks, "party_code"), "gender", "riskcategory", "incomedetails", "occupation", "City", "birthdate").select(
        F.col("party_code").alias("party_code1"), "gender", "riskcategory", "incomedetails", "occupation", "City",
        C.age_years(F.col("birthdate"), C.as_date(as_of), 2).alias("age"),
    )
    same_day = (F.col("party_code") == F.col("party_id")) & (F.col("sauda_date") == F.col("sauda_date2"))
    same_person = F.col("party_code") == F.col("party_code1")
    if chained:
        same_day, same_person = same_day & F.col("party_code2").isNotNull(), same_person & F.col("party_id").isNotNull()
    joined = (
        base.dealt(targets, tasks, "party_code", "sauda_date").join(turnover, (F.col("party_code") == F.col("party_code2")) & (F.col("sauda_date") == F.col("sauda_date1")), "left")
        .join(profile, same_day, "left")
    )
    joined = base.dealt(joined, tasks, "party_code").join(person, same_person, "left")
    return joined.select(
        "party_code", "sauda_date", "cutoff_sauda_date", "cumulative_trade_days", "target_trade_days",
        "settle_target", "frequent_target",
        *[F.coalesce(flag, F.lit(0)).cast("boolean").alias(flag) for flag in codes.TRADE_FLAGS],
        "gender", "riskcategory", "incomedetails", "occupation", "City", "Brokerage", "T_O",
        *COUNTERS, "rejected_by_cnt", "underlying_assets_cnt", "age",
    )


def settle_dataset(mart: DataFrame, tiers: DataFrame, max_date=None) -> DataFrame:
    """First-trade rows with the settle target, keys and sparse counters removed."""
    rows = base.dates_between(mart, last=max_date).filter(F.col("cumulative_trade_days") == 1)
    rows = with_tier(rows, tiers).withColumn("gender", C.gender_label(F.col("gender")))
    return rows.drop(
        "party_code", "sauda_date", "cutoff_sauda_date", "cumulative_trade_days", "target_trade_days", "City",
        "frequent_target", *codes.SPARSE_COUNTERS,
    )


SUMMED = ["Brokerage", "T_O", *COUNTERS, "rejected_by_cnt", "underlying_assets_cnt", "age"]


def frequent_dataset(mart: DataFrame, tiers: DataFrame, max_date=None) -> DataFrame:
    """Second and third trade days folded to one row per party, with the frequent target.

    Flags are or-ed and amounts summed (no value counts as 0). A party whose
    target or attributes differ between its rows keeps one row for each.
    """
    rows = base.dates_between(mart, last=max_date).filter(F.col("cumulative_trade_days").isin(2, 3))
    labels = ["frequent_target", "gender", "riskcategory", "incomedetails", "occupation", "City"]
    rows = rows.withColumn("gender", C.gender_label(F.col("gender")))
    folded = rows.groupBy("party_code").agg(
        *[F.bool_or(flag).alias(flag) for flag in codes.TRADE_FLAGS],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED],
        F.collect_set(F.struct(*labels)).alias("labels"),
    )
    out = folded.select(*codes.TRADE_FLAGS, *SUMMED, F.inline("labels"))
    return with_tier(out, tiers).drop("City", *codes.SPARSE_COUNTERS)
