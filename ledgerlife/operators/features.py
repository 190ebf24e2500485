"""Per-party features and the next-trade target around a trade day or week.

A day's user has traded on that day, so every (party, day) pair is a row of the
party-day frame. History, recency and the next trade are range frames of one
per-party window over it. Two shuffles, by (party, day) and by party, serve all
features of all days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlife.functions import columns as C
from ledgerlife.operators import base
from ledgerlife.operators.calendar import BusinessDays


def _day_totals() -> list[Column]:
    return [
        F.count("*").alias("day_trades"),
        F.sum("OC").alias("day_orders"),
        F.sum("T_O").alias("day_turnover"),
        F.count("T_O").alias("day_turnover_rows"),
    ]


def _enough(count: Column, min_days: int | None, max_days: int | None) -> Column:
    keep = F.lit(True)
    if min_days is not None:
        keep = keep & (count >= min_days)
    if max_days is not None:
        keep = keep & (count <= max_days)
    return keep


def _trade_stats(history: int) -> dict[str, Column]:
    past = base.day_range(-history, 0)
    return {
        "trade_days_cnt": F.count("*").over(past),
        "total_trades": F.sum("day_trades").over(past),
        "total_order_count": F.sum("day_orders").over(past),
        "avg_investment": F.try_divide(F.sum("day_turnover").over(past), F.sum("day_turnover_rows").over(past)),
    }


def cohort_trade_stats(
    trades: DataFrame,
    kyc: DataFrame | None,
    days=None,
    history: int = 30,
    min_days: int | None = 4,
    max_days: int | None = None,
) -> DataFrame:
    """Trade days, trades, orders and mean turnover over the last ``history`` days of each day's users."""
    seen = base.around(trades, days, history, 0)
    activity = base.party_days(seen, *_day_totals(), kyc=kyc).withColumns(_trade_stats(history))
    kept = base.requested(activity, days).filter(_enough(F.col("trade_days_cnt"), min_days, max_days))
    return kept.select(
        "party_code", "sauda_date", "trade_days_cnt", "total_trades", "total_order_count", "avg_investment"
    )


def _next_trade(horizon: int) -> dict[str, Column]:
    ahead = base.day_range(1, horizon)
    return {"next_seen": F.min("sauda_date").over(ahead), "future_days": F.count("*").over(ahead)}


def _target(
    horizon: int, default_after: int, min_future: int | None, max_future: int | None, calendar_days: int
) -> dict[str, Column]:
    day = F.col("sauda_date")
    counted = F.when(_enough(F.col("future_days"), min_future, max_future), F.col("next_seen"))
    next_trade = F.coalesce(counted, F.date_add(day, default_after))
    return {
        "next_trade": next_trade,
        "inactive_days": BusinessDays.gap(day, next_trade, day, F.date_add(day, calendar_days)),
    }


def next_trade_target(
    trades: DataFrame,
    kyc: DataFrame | None,
    calendar: DataFrame,
    days=None,
    horizon: int = 61,
    min_future_days: int | None = 1,
    max_future_days: int | None = None,
    default_after: int = 65,
    calendar_days: int = 60,
) -> DataFrame:
    """Next trade of each day's users and the business days without one until then.

    A party counts as returning only when its trade days in the horizon lie in
    ``min_future_days``..``max_future_days``; others get ``default_after``.
    """
    seen = base.around(trades, days, 0, horizon)
    activity = base.party_days(seen, kyc=kyc).withColumns(_next_trade(horizon))
    target = _target(horizon, default_after, min_future_days, max_future_days, calendar_days)
    rows = BusinessDays(calendar).attach(base.requested(activity, days))
    return rows.withColumns(target).select("party_code", "sauda_date", "future_days", "next_trade", "inactive_days")


def _lagged_days(history: int) -> dict[str, Column]:
    """The three trade days before the current one, unless older than the history."""
    oldest = F.date_sub("sauda_date", history)
    lags = {}
    for step in (1, 2, 3):
        earlier = F.lag("sauda_date", step).over(base.in_day_order())
        lags[f"before_{step}"] = F.when(earlier >= oldest, earlier)
    return lags


def _gaps(anchor: Column, start: Column) -> dict[str, Column]:
    """Business-day gaps between the anchor and its three earlier days.

    A missing day is taken as the start of the history; the second gap then
    gains 30 days and the third 60.
    """
    filled = [anchor] + [F.coalesce(F.col(f"before_{step}"), start) for step in (1, 2, 3)]
    gaps = {}
    for step, name, penalty in ((1, "gap_1", 0), (2, "gap_2", 30), (3, "gap_3", 60)):
        missing = F.when(F.col(f"before_{step}").isNull(), penalty).otherwise(0)
        gaps[name] = BusinessDays.gap(filled[step], filled[step - 1]) + missing
    return gaps


def _gap_summary() -> dict[str, Column]:
    gaps = [F.col("gap_1"), F.col("gap_2"), F.col("gap_3")]
    return {"mean_last_3": C.row_mean(*gaps), "stddev_last_3": C.row_stddev(*gaps)}


RECENCY = ["gap_1", "gap_2", "gap_3", "mean_last_3", "stddev_last_3"]


def recency_features(trades: DataFrame, calendar: DataFrame, days=None, history: int = 30) -> DataFrame:
    """Last three business-day gaps of each day's users, their mean and spread."""
    seen = base.around(trades, days, history, 0)
    lagged = base.party_days(seen).withColumns(_lagged_days(history))
    rows = BusinessDays(calendar).attach(base.requested(lagged, days))
    gaps = _gaps(F.col("sauda_date"), F.date_sub("sauda_date", history))
    return rows.withColumns(gaps).withColumns(_gap_summary()).select("party_code", "sauda_date", *RECENCY)


def next_trade_dataset(
    trades: DataFrame,
    kyc: DataFrame,
    calendar: DataFrame,
    tiers: DataFrame | None = None,
    days=None,
    history: int = 30,
    horizon: int = 61,
    min_days: int | None = 4,
    max_days: int | None = None,
    min_future_days: int | None = 1,
    max_future_days: int | None = None,
    with_recency: bool = True,
    default_after: int = 65,
    calendar_days: int = 60,
) -> DataFrame:
    """Features and target of every user of the given days, ready for a model.

    Trade statistics, next trade and recency share one window pass. The segment
    below four trade days (``max_days=3``) goes without recency features.
    """
    seen = base.around(trades, days, history, horizon)
    activity = base.party_days(seen, *_day_totals(), kyc=kyc)
    activity = activity.withColumns(_trade_stats(history) | _next_trade(horizon) | _lagged_days(history))
    rows = base.requested(activity, days).filter(_enough(F.col("trade_days_cnt"), min_days, max_days))
    rows = BusinessDays(calendar).attach(rows)
    rows = rows.withColumns(_target(horizon, default_after, min_future_days, max_future_days, calendar_days))
    kept = ["party_code", "sauda_date", "trade_days_cnt", "total_trades", "total_order_count", "avg_investment"]
    if with_recency:
        rows = rows.withColumns(_gaps(F.col("sauda_date"), F.date_sub("sauda_date", history)))
        rows = rows.withColumns(_gap_summary())
        kept += RECENCY
    return with_demographics(rows.select(*kept, "next_trade", "inactive_days"), kyc, tiers)


def week_cohort(
    trades: DataFrame,
    kyc: DataFrame | None,
    calendar: DataFrame,
    weeks: Sequence | None = None,
    history: int = 30,
    horizon: tuple[int, int] = (5, 66),
    min_days: int | None = 4,
    max_days: int | None = None,
    min_future_days: int | None = 1,
    max_future_days: int | None = None,
    default_after: int = 65,
    calendar_days: int = 64,
    week_days: int = 4,
) -> DataFrame:
    """Statistics, target and recency of the users of a week (start day to start + 4).

    ``weeks`` are start days; without them every Monday is one. The first trade day of a party in a week
    brings a mark at the week's start; history, week and horizon are range frames of one per-party window around the
    marks, so no party-day is copied to the weeks that cover it.
    """
    first_seen, last_seen = horizon
    seen = base.around(trades, weeks, history, last_seen)
    activity = base.party_days(seen, *_day_totals(), kyc=kyc)
    day, week, values = F.col("sauda_date"), F.col("week_start"), ("day_trades", "day_orders", "day_turnover", "day_turnover_rows")
    order = base.by_party().orderBy("sauda_date")
    activity = activity.withColumns({f"_back_{step}": F.lag("sauda_date", step).over(order) for step in (1, 2, 3)})
    if weeks is None:
        covering = F.array(F.date_sub(F.next_day(day, "MON"), 7))
    else:
        covering = C.date_list(weeks)
    begun = F.filter(covering, lambda start: start.between(F.date_sub(day, week_days), day) & F.coalesce(F.col("_back_1") < start, F.lit(True)))
    none = F.lit(None).cast("date")
    marked = activity.withColumn("week_start", F.explode(F.concat(F.array(none), begun)))
    trade = week.isNull()
    marked = marked.withColumns({"_n": F.unix_date(F.coalesce(week, day)), **{v: F.when(trade, F.col(v)) for v in values}})
    marked = marked.withColumn("_day", F.when(trade, F.struct(day.alias("day"), "_back_1", "_back_2", "_back_3")))

    def within(first: int, last: int):
        return base.by_party().orderBy("_n").rangeBetween(first, last)

    past, in_week, ahead = within(-history, 0), within(0, week_days), within(first_seen, last_seen)
    framed = marked.withColumns(
        {
            "_anchor": F.max("_day").over(in_week),
            "trade_days_cnt": F.count("_day").over(past),
            "total_trades": F.sum("day_trades").over(past),
            "total_order_count": F.sum("day_orders").over(past),
            "avg_investment": F.try_divide(F.sum("day_turnover").over(past), F.sum("day_turnover_rows").over(past)),
            "next_seen": F.min("_day.day").over(ahead),
            "future_days": F.count("_day").over(ahead),
        }
    ).filter(week.isNotNull())
    kept = framed.filter(_enough(F.col("trade_days_cnt"), min_days, max_days)).withColumn("anchor", F.col("_anchor.day"))
    counted = F.when(_enough(F.col("future_days"), min_future_days, max_future_days), F.col("next_seen"))
    rows = BusinessDays(calendar).attach(kept).withColumns(
        {f"before_{step}": F.when(F.col(f"_anchor._back_{step}") >= F.date_sub(week, history), F.col(f"_anchor._back_{step}")) for step in (1, 2, 3)}
        | {"next_trade": F.coalesce(counted, F.date_add(week, default_after))}
    )
    anchor = F.col("anchor")
    target = BusinessDays.gap(anchor, F.col("next_trade"), week, F.date_add(week, calendar_days))
    rows = rows.withColumns({"inactive_days": target} | _gaps(anchor, F.date_sub(week, history)))
    rows = rows.withColumns(_gap_summary())
    return rows.select(
        "party_code", "week_start", "anchor", "trade_days_cnt", "total_trades", "total_order_count",
        "avg_investment", "next_trade", "inactive_days", *RECENCY,
    )


def city_tiers(tiers: DataFrame, order: str | None = None) -> DataFrame:
    """City to tier, one row per city; of repeated cities the last by ``order`` wins."""
    known = tiers.filter(F.col("Tier").isNotNull())
    pick = F.max("Tier") if order is None else F.max_by("Tier", order)
    return known.groupBy("City").agg(pick.alias("Tier"))


def with_tier(df: DataFrame, tiers: DataFrame, city: str = "City", order: str | None = None) -> DataFrame:
    """Add the tier of each row's city; cities that are not listed get the lowest tier.

    The lookup carries no hint: Spark broadcasts it when its measured size is
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    found = city_tiers(tiers, order).withColumnsRenamed({"City": "_city", "Tier": "_tier"})
    joined = df.join(found, C.capitalized(F.col(city)) == F.col("_city"), "left")
    return joined.withColumn("Tier", F.coalesce("_tier", F.lit(C.codes.UNLISTED_CITY_TIER))).drop("_city", "_tier")


def kyc_rows(kyc: DataFrame, *columns: str) -> DataFrame:
    """Distinct customer attributes (the customer table may repeat rows)."""
    return kyc.select("party_code", *columns).distinct()


def demographic_features(
    kyc: DataFrame, tiers: DataFrame, as_of, unknown_occupation: str = "other", unknown_risk: str = "other"
) -> DataFrame:
    """Encoded customer attributes, one row per distinct customer row."""
    as_of = C.as_date(as_of)
    rows = kyc_rows(
        kyc, "gender", "riskcategory", "incomedetails", "occupation", "birthdate", "activefrom", "City"
    )
    age = C.age_years(F.col("birthdate"), as_of)
    rows = rows.withColumns(
        {
            "age": C.age_years(F.col("birthdate"), as_of, 2),
            "new_age": C.age_bucket(age),
            "activeinsys": F.datediff(as_of, "activefrom"),
            "new_incomedetails": C.income_bucket(F.col("incomedetails")),
            "gender_f": C.gender_flag(F.col("gender")),
            "riskcategory_new": C.risk_ordinal(F.col("riskcategory")),
        }
    )
    rows = with_tier(rows, tiers).na.fill({"occupation": unknown_occupation, "riskcategory": unknown_risk})
    return rows.select(
        "party_code", "age", "new_age", "activeinsys", "new_incomedetails", "gender_f", "riskcategory_new",
        "occupation", "riskcategory", "Tier",
    )


def with_demographics(df: DataFrame, kyc: DataFrame, tiers: DataFrame | None, day: str = "sauda_date") -> DataFrame:
    """Join a party-day frame to encoded customer attributes as of its own day."""
    rows = kyc_rows(
        kyc.filter(F.col("B2C") == "Y"),
        "gender", "riskcategory", "incomedetails", "occupation", "birthdate", "activefrom", "City",
    )
    if tiers is not None:
        rows = with_tier(rows, tiers)
    rows = rows.na.fill({"occupation": "other"}).withColumns(
        {
            "new_incomedetails": C.income_bucket(F.col("incomedetails")),
            "gender_f": C.gender_flag(F.col("gender")),
            "riskcategory_new": C.risk_ordinal(F.col("riskcategory")),
        }
    )
    joined = df.join(rows, "party_code", "left")
    return joined.withColumns(
        {
            "new_age": C.age_bucket(C.age_years(F.col("birthdate"), F.col(day))),
            "activeinsys": F.datediff(F.col(day), "activefrom"),
        }
    ).drop("gender", "riskcategory", "incomedetails", "birthdate", "activefrom", "City")


def instrument_mix(trades: DataFrame, days=None) -> DataFrame:
    """Trades by day and instrument, over all customers."""
    return base.requested(trades, days).groupBy("sauda_date", "INST_TYPE").agg(F.count("*").alias("Total"))


def instrument_mix_by_inactivity(
    trades: DataFrame,
    kyc: DataFrame | None,
    calendar: DataFrame,
    days=None,
    horizon: int = 61,
    min_future_days: int = 4,
    calendar_days: int = 60,
) -> DataFrame:
    """Instruments traded on a day, by how long their users then stayed away.

    Only users that return in the horizon count. The instruments of a party-day
    travel through the window as a small array (one entry per instrument code).
    """
    seen = base.around(trades, days, 0, horizon)
    per_code = seen.groupBy("party_code", "sauda_date", "INST_TYPE").agg(F.count("*").alias("trades"))
    activity = base.party_days(per_code, F.collect_list(F.struct("INST_TYPE", "trades")).alias("codes"), kyc=kyc)
    rows = base.requested(activity.withColumns(_next_trade(horizon)), days)
    rows = BusinessDays(calendar).attach(rows.filter(F.col("future_days") >= min_future_days))
    day = F.col("sauda_date")
    idle = BusinessDays.gap(day, F.col("next_seen"), day, F.date_add(day, calendar_days))
    return (
        rows.withColumn("bucket", C.inactivity_bucket(idle))
        .select("sauda_date", "bucket", F.inline("codes"))
        .groupBy("sauda_date", "bucket", "INST_TYPE")
        .agg(F.sum("trades").alias("Total"))
    )


def baseline_predictor(df: DataFrame) -> DataFrame:
    """Predict the next gap as the mean of the last three."""
    return df.withColumn("prediction", F.col("mean_last_3"))
