"""Shapes every operator starts from: B2C parties, party-days, requested days.

``party_days`` is the one place where raw trades are reduced. Its partial
aggregation runs before the shuffle and its keys are (party, day), so a party
that holds a large share of the raw rows arrives at later per-party windows as
at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.functions import columns as C
from ledgerlife.session import reused


def b2c_only(rows: DataFrame, kyc: DataFrame | None) -> DataFrame:
    """Rows of B2C parties; without a customer table every row is kept.

    Applied to reduced rows: a customer table too large to broadcast is then
    joined on the partitioning that the per-party window needs anyway, and no
    raw trades are shuffled by party. Spark moves the semi join below the
    aggregation by itself when the customer side can be broadcast.
    """
    if kyc is None:
        return rows
    return rows.join(kyc.filter(F.col("B2C") == "Y").select("party_code"), "party_code", "left_semi")


def party_days(trades: DataFrame, *aggregates: Column, kyc: DataFrame | None = None) -> DataFrame:
    """One row per (B2C) party and trade day, with optional per-day aggregates."""
    keys = ["party_code", "sauda_date"]
    reduced = trades.groupBy(*keys).agg(*aggregates) if aggregates else trades.select(*keys).distinct()
    return b2c_only(reduced, kyc)


def by_party() -> Window:
    return Window.partitionBy("party_code")


def in_day_order() -> Window:
    """Per party by day number, so range frames count calendar days."""
    return by_party().orderBy(F.unix_date("sauda_date"))


def day_range(first: int, last: int) -> Window:
    """The party's rows from ``first`` to ``last`` days around the current one."""
    return in_day_order().rangeBetween(first, last)


def dates_between(trades: DataFrame, first=None, last=None, column: str = "sauda_date") -> DataFrame:
    if first is not None:
        trades = trades.filter(F.col(column) >= C.as_date(first))
    if last is not None:
        trades = trades.filter(F.col(column) <= C.as_date(last))
    return trades


def around(trades: DataFrame, days, back: int, ahead: int) -> DataFrame:
    """Prune the scan to the dates that the asked-for days can see (all for None).

    The range of a frame's days is a pair of scalar subqueries.
    """
    if days is None:
        return trades
    if isinstance(days, DataFrame):
        span = days.select(F.col(days.columns[0]).cast("date").alias("_day"))
        low, high = span.agg(F.min("_day")).scalar(), span.agg(F.max("_day")).scalar()
        return trades.filter(F.col("sauda_date").between(F.date_sub(low, back), F.date_add(high, ahead)))
    ordered = sorted(str(d) for d in days)
    return dates_between(
        trades, F.date_sub(C.as_date(ordered[0]), back), F.date_add(C.as_date(ordered[-1]), ahead)
    )


def requested(df: DataFrame, days, column: str = "sauda_date") -> DataFrame:
    """Keep the asked-for days: all (None), a list of dates, or a frame's first column."""
    if days is None:
        return df
    if isinstance(days, DataFrame):
        wanted = days.select(F.col(days.columns[0]).cast("date").alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.filter(F.col(column).isin([C.as_date(d) for d in days]))


def dealt(rows: DataFrame, tasks: int | None, *keys) -> DataFrame:
    """Rows hashed by the keys over a number of tasks; without one they are left to Spark's own exchanges.

    Spark sizes the tasks after its exchanges by compressed bytes, which for wide rows of small counts are millions of rows.
    """
    return rows if tasks is None else rows.repartition(tasks, *keys)


#: Shares of the rows of a busy group that are reduced apart before they meet.
SHARES = 16


def in_shares(rows: DataFrame, tasks: int, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Rows reduced by the keys and a share, dealt over a number of tasks; shares go by a hash of the other columns.

    The caller reduces once more by the keys. A group in the map tasks would hold as many rows as a split of the files has.
    """
    share = F.pmod(F.hash(*[c for c in rows.columns if c not in keys]), F.lit(SHARES))
    return dealt(rows.withColumn("_share", share), tasks, *keys, "_share").groupBy(*keys, "_share").agg(*aggregates)


def one_per_key(df: DataFrame, keys: list[str], order: str, last: bool = False, ties: Sequence[str] | None = None) -> DataFrame:
    """The first (or last) row of each key by an ordering column; rows without it come last.

    Equal rows of the order go by the columns ``ties``, by default all others in their order, so reruns agree.
    A rank of one, which Spark cuts to a row per key in each task before the shuffle.
    """
    column = F.col(order).desc_nulls_last() if last else F.col(order).asc_nulls_last()
    rest = [c for c, kind in df.dtypes if c not in (*keys, order) and not kind.startswith("map")] if ties is None else ties
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(column, *rest))
    return df.select("*", place.alias("_place")).filter("_place = 1").drop("_place").select(*keys, *[c for c in df.columns if c not in keys])


def placed(df: DataFrame, *order, into: str = "_place") -> DataFrame:
    """Rows with their place from 0 in an order, counted within ranges of it and after the ranges before.

    The order should tell rows apart: rows that agree in it all go to one range.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number that Spark gives a row holds its range in the upper bits and its place there in the lower 33.
    ranged = reused(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    found = ranged.withColumn("_part", part).join(before, "_part")
    return found.select(*df.columns, (F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")).alias(into))


def append_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Result frames stacked by column name; columns one lacks are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
