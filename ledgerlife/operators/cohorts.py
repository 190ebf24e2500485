"""First-trade cohorts and their dormancy over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlife.functions import columns as C
from ledgerlife.operators import base


def first_trade_cohort(trades: DataFrame) -> DataFrame:
    """First and last trade per party, and the month it became active."""
    return (
        trades.groupBy("party_code")
        .agg(F.min("sauda_date").alias("first_trade"), F.max("sauda_date").alias("last_trade"))
        .withColumn("activation_month", F.trunc("first_trade", "month"))
    )


def dormancy_rate(trades: DataFrame, kyc: DataFrame | None, as_of, start, end, dormant_after: int = 60) -> DataFrame:
    """Share of the parties first seen in ``start``..``end`` that are dormant at ``as_of``."""
    as_of = C.as_date(as_of)
    parties = base.b2c_only(first_trade_cohort(base.dates_between(trades, last=as_of)), kyc)
    idle = F.datediff(as_of, "last_trade")
    return (
        parties.filter(F.col("first_trade").between(C.as_date(start), C.as_date(end)))
        .agg(F.count("*").alias("parties"), F.count_if(idle > dormant_after).alias("dormant"))
        .withColumn("dormancy_pct", C.percent(F.col("dormant"), F.col("parties")))
    )


def dormancy_matrix(
    trades: DataFrame,
    kyc: DataFrame | None,
    cohorts: Sequence[tuple],
    as_of_dates: Sequence,
    dormant_after: int = 60,
) -> DataFrame:
    """Dormancy of every (cohort, as-of date) cell that lies far enough apart.

    Cohorts may overlap: a party counts in each one that holds its first trade.

    One scan and two shuffles whatever the grid size: per party the last trade
    up to each as-of date, then per cohort the dormant count for each date.
    """
    as_of = [C.as_date(d) for d in as_of_dates]
    latest = max(str(d) for d in as_of_dates)
    seen = base.dates_between(trades, last=latest)
    day = F.col("sauda_date")
    parties = seen.groupBy("party_code").agg(
        F.min(day).alias("first_trade"),
        *[F.max(F.when(day <= d, day)).alias(f"last_{i}") for i, d in enumerate(as_of)],
    )
    spans = F.array(*[F.struct(C.as_date(a).alias("cohort_start"), C.as_date(b).alias("cohort_end")) for a, b in cohorts])
    held = F.filter(spans, lambda c: F.col("first_trade").between(c["cohort_start"], c["cohort_end"]))
    grouped = (
        base.b2c_only(parties, kyc)
        .select("*", F.inline(held))
        .groupBy("cohort_start", "cohort_end")
        .agg(
            F.count("*").alias("parties"),
            *[F.count_if(F.datediff(d, f"last_{i}") > dormant_after).alias(f"n_{i}") for i, d in enumerate(as_of)],
        )
    )
    cells = F.array(*[F.struct(d.alias("as_of"), F.col(f"n_{i}").alias("dormant")) for i, d in enumerate(as_of)])
    return (
        grouped.select("cohort_start", "cohort_end", "parties", F.inline(cells))
        .filter(F.col("as_of") > F.date_add("cohort_end", dormant_after))
        .withColumn("dormancy_pct", C.percent(F.col("dormant"), F.col("parties")))
    )


def dormancy_grid(cells: DataFrame, as_of_dates: Sequence) -> DataFrame:
    """The matrix as a table: one row per cohort, one column per as-of date."""
    labels = [str(d) for d in as_of_dates]
    return (
        cells.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))
        .groupBy("cohort_start")
        .pivot("as_of", labels)
        .agg(F.first("dormancy_pct"))
    )
