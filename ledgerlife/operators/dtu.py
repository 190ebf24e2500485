"""Daily transacting users: age mix, return rate and trading frequency.

All three views come from one frame of party-days: a party's first trade and
its later trades are read off range frames of a single per-party window, so
the cost does not depend on how many days are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlife.functions import columns as C
from ledgerlife.operators import base

TYPES = ("type1", "type2", "type3")


def _type_of(age: Column, old_after: int) -> Column:
    return F.when(age >= old_after, "type1").when(age >= 1, "type2").otherwise("type3")


def daily_users(trades: DataFrame, kyc: DataFrame | None, old_after: int = 90) -> DataFrame:
    """One row per party and trade day with the party's type on that day."""
    days = base.party_days(trades, kyc=kyc)
    first = F.min("sauda_date").over(base.in_day_order())  # same order as the range frames: one sort
    return days.withColumn("customer_type", _type_of(F.datediff("sauda_date", first), old_after))


def _type_counts() -> list[Column]:
    counts = [F.count("*").alias("users")]
    return counts + [F.count_if(F.col("customer_type") == kind).alias(kind) for kind in TYPES]


def _type_shares() -> dict[str, Column]:
    return {f"{kind}_pct": C.percent(F.col(kind), F.col("users")) for kind in TYPES}


def dtu_type_mix(trades: DataFrame, kyc: DataFrame | None, days=None, old_after: int = 90) -> DataFrame:
    """Per day: users whose first trade is old, recent, or that very day."""
    users = base.requested(daily_users(trades, kyc, old_after), days)
    return users.groupBy("sauda_date").agg(*_type_counts()).withColumns(_type_shares())


# Return bands in days after the trade day.
RETURN_BANDS = {"t1": (1, 1), "t7": (2, 7), "t30": (8, 30)}


def _returns(bands: dict) -> dict[str, Column]:
    return {f"back_{name}": F.count("*").over(base.day_range(*band)) > 0 for name, band in bands.items()}


def dtu_return_rate(trades: DataFrame, kyc: DataFrame | None, days=None, bands: dict | None = None) -> DataFrame:
    """Per day: share of users that trade again in each band of later days."""
    bands = bands or RETURN_BANDS
    seen = base.around(trades, days, 0, max(high for _, high in bands.values()))
    users = base.party_days(seen, kyc=kyc).withColumns(_returns(bands))
    return (
        base.requested(users, days)
        .groupBy("sauda_date")
        .agg(F.count("*").alias("users"), *[F.count_if(f"back_{name}").alias(name) for name in bands])
        .withColumns({f"{name}_pct": C.percent(F.col(name), F.col("users")) for name in bands})
    )


def dtu_profile(trades: DataFrame, kyc: DataFrame | None, days=None, old_after: int = 90) -> DataFrame:
    """Type mix and return rate of each day in one row, from one pass."""
    users = base.requested(daily_users(trades, kyc, old_after).withColumns(_returns(RETURN_BANDS)), days)
    shares = _type_shares() | {f"{n}_pct": C.percent(F.col(n), F.col("users")) for n in RETURN_BANDS}
    return (
        users.groupBy("sauda_date")
        .agg(*_type_counts(), *[F.count_if(f"back_{name}").alias(name) for name in RETURN_BANDS])
        .select("sauda_date", "users", *[share.alias(name) for name, share in shares.items()])
    )


def trade_day_count_mix(
    trades: DataFrame, kyc: DataFrame | None, days=None, old_after: int = 90, ahead: int = 30
) -> DataFrame:
    """Per day and type: how many days its users trade in the days ahead.

    The ``pct_1`` band is what the three counted bands leave of 100, so it also
    holds the users that never come back.
    """
    later = F.count("*").over(base.day_range(1, ahead))
    users = base.requested(daily_users(trades, kyc, old_after).withColumn("later_days", later), days)
    bands = {
        "pct_2_5": F.col("later_days").between(2, 5),
        "pct_6_10": F.col("later_days").between(6, 10),
        "pct_gt_10": F.col("later_days") > 10,
    }
    shares = (
        users.groupBy("sauda_date", "customer_type")
        .agg(F.count("*").alias("users"), *[F.count_if(hit).alias(name) for name, hit in bands.items()])
        .withColumns({name: C.percent(F.col(name), F.col("users")) for name in bands})
    )
    counted = F.col("pct_2_5") + F.col("pct_6_10") + F.col("pct_gt_10")
    return shares.withColumn("pct_1", F.round(F.lit(100.0) - counted, 2))
