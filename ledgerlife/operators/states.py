"""Daily trade summary, stage-transition targets and customer states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlife.functions import codes
from ledgerlife.functions import columns as C
from ledgerlife.operators import base


def daily_summary(trades: DataFrame, flags: Mapping[str, Sequence[str]], tasks: int | None = None) -> DataFrame:
    """One row per party and trade day: running day count, mean of the last four gaps, product flags.

    ``flags`` maps each flag column to the instrument codes that set it. With a
    number of ``tasks`` the party-days and then the parties are dealt over so many.
    """
    marks = [
        F.max(F.when(F.col("INST_TYPE").isin(list(flags.get(name, []))), 1).otherwise(0)).alias(name)
        if flags.get(name)
        else F.max(F.lit(0)).alias(name)
        for name in codes.TRADE_FLAGS
    ]
    order = base.by_party().orderBy("sauda_date")
    gap = F.datediff("sauda_date", F.lag("sauda_date").over(order))
    if tasks is None:
        days = base.party_days(trades, *marks)
    else:
        shares = base.in_shares(trades, tasks, ["party_code", "sauda_date"], *marks)
        days = base.party_days(base.dealt(shares, tasks, "party_code"), *[F.max(name).alias(name) for name in codes.TRADE_FLAGS])
    days = days.withColumn("gap", gap)
    mean_gap = F.avg("gap").over(order.rowsBetween(-3, 0))
    return (
        days.withColumns({"cumulative_trade_days": F.row_number().over(order), "mean_gap": mean_gap})
        .withColumn("average_gap_last_four_trades_weeks", F.col("mean_gap") / F.lit(7.0))
        .withColumn("average_gap_last_four_trades_label", C.gap_label(F.col("mean_gap")))
        .select(
            "party_code", "sauda_date", "cumulative_trade_days", "average_gap_last_four_trades_weeks",
            "average_gap_last_four_trades_label", *codes.TRADE_FLAGS,
        )
    )


def transition_targets(
    daily: DataFrame, start=None, end=None, horizon_days: int | None = 30, tasks: int | None = None
) -> DataFrame:
    """Trade days a party reaches within the horizon, and the two targets derived from it.

    ``horizon_days=None`` takes the highest count of the whole date range for
    every row of the party instead of looking ahead from each row. A number of
    ``tasks`` deals the parties over so many; a stored summary has lost its own dealing.
    """
    rows = base.dealt(base.dates_between(daily, start, end), tasks, "party_code")
    frame = base.by_party() if horizon_days is None else base.day_range(0, horizon_days)
    reached = F.max("cumulative_trade_days").over(frame)
    return (
        rows.withColumns({"cutoff_sauda_date": F.date_add("sauda_date", horizon_days or 30), "target_trade_days": reached})
        .withColumn("settle_target", C.settle_target(F.col("target_trade_days")))
        .withColumn("frequent_target", C.frequent_target(F.col("target_trade_days"), F.col("cumulative_trade_days")))
    )


# State names; recency splits the frequent stage.
STATES = {
    "none": "KYC",
    "first": "First Sauda",
    "settling": "Settling-In",
    "dormant": "Dormant",
}
RECENCY_STATES = {"W-r": 7, "BW-r": 15, "M-r": 30, "Q-r": 90}


def _state(trade_days: Column, idle: Column, dormant_after: int) -> Column:
    state = F.when(trade_days.isNull(), STATES["none"]).when(idle > dormant_after, STATES["dormant"])
    state = state.when(trade_days == 1, STATES["first"]).when(trade_days < 4, STATES["settling"])
    for label, limit in RECENCY_STATES.items():
        state = state.when(idle <= limit, f"Frequent {label}")
    return state.otherwise("Frequent")


def _states_by_party(
    daily: DataFrame, as_of_dates: Sequence, kyc: DataFrame | None, dormant_after: int
) -> DataFrame:
    """One row per party with the array of its states, one entry per as-of date in order."""
    day = F.col("sauda_date")
    dates = [C.as_date(d) for d in sorted(str(d) for d in as_of_dates)]
    parties = daily.groupBy("party_code").agg(
        *[F.max(F.when(day <= d, day)).alias(f"last_{i}") for i, d in enumerate(dates)],
        *[F.max(F.when(day <= d, F.col("cumulative_trade_days"))).alias(f"days_{i}") for i, d in enumerate(dates)],
    )
    if kyc is not None:
        parties = kyc.select("party_code").distinct().join(parties, "party_code", "left")
    states = [
        F.struct(d.alias("as_of"), _state(F.col(f"days_{i}"), F.datediff(d, f"last_{i}"), dormant_after).alias("state"))
        for i, d in enumerate(dates)
    ]
    return parties.select("party_code", F.array(*states).alias("states"))


def user_state(
    daily: DataFrame, as_of_dates: Sequence, kyc: DataFrame | None = None, dormant_after: int = 90
) -> DataFrame:
    """State of every party at each as-of date; with a customer table also of those yet to trade."""
    return _states_by_party(daily, as_of_dates, kyc, dormant_after).select("party_code", F.inline("states"))


def state_transitions(
    daily: DataFrame, as_of_dates: Sequence, kyc: DataFrame | None = None, dormant_after: int = 90
) -> DataFrame:
    """Parties by state at one as-of date and state at the next."""
    states = F.col("states")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(states) - 2),
        lambda i: F.struct(
            F.get(states, i)["as_of"].alias("as_of"),
            F.get(states, i + 1)["as_of"].alias("next_as_of"),
            F.get(states, i)["state"].alias("state"),
            F.get(states, i + 1)["state"].alias("next_state"),
        ),
    )
    return (
        _states_by_party(daily, as_of_dates, kyc, dormant_after)
        .select(F.inline(steps))
        .groupBy("as_of", "next_as_of", "state", "next_state")
        .agg(F.count("*").alias("parties"))
    )
