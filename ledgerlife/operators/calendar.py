"""Trading calendar: day ranges, closed days and business-day gaps.

A calendar has one row per trading day (a few hundred a year), so it is folded
into a single scalar-subquery value: the first day and, for each day since, how
many trading days have passed. Any business-day count is then two array lookups
in generated code; no join and no shuffle of the fact side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlife.functions import columns as C


def date_range(spark: SparkSession, start, end) -> DataFrame:
    """Every calendar day from ``start`` to ``end``, both included."""
    return spark.range(1).select(F.explode(F.sequence(C.as_date(start), C.as_date(end))).alias("day"))


def trading_day_list(calendar: DataFrame) -> DataFrame:
    return calendar.select(F.col("TradingDay").cast("date").alias("day")).filter(F.col("day").isNotNull()).distinct()


def closed_days(calendar: DataFrame, start=None, end=None, days: DataFrame | None = None) -> DataFrame:
    """Days of the range, or of a frame with column ``day``, on which there is no trading."""
    days = date_range(calendar.sparkSession, start, end) if days is None else days.select("day").distinct()
    return days.join(trading_day_list(calendar), "day", "left_anti")


def check_trading_days(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each requested day with a flag that says whether it is a trading day."""
    name = days.columns[0]
    marked = trading_day_list(calendar).withColumn("is_trading_day", F.lit(True))
    return (
        days.select(F.col(name).cast("date").alias("day"))
        .distinct()
        .join(marked, "day", "left")
        .select("day", F.coalesce("is_trading_day", F.lit(False)).alias("is_trading_day"))
    )


def require_trading_day(calendar: DataFrame, day) -> None:
    """Raise unless ``day`` is a trading day."""
    if trading_day_list(calendar).filter(F.col("day") == C.as_date(day)).isEmpty():
        raise ValueError(f"{day} is not a trading day")


class BusinessDays:
    """Column expressions over one trading calendar."""

    def __init__(self, calendar: DataFrame):
        order = Window.orderBy("day")
        days = trading_day_list(calendar).select(
            "day", F.row_number().over(order).alias("rank"), F.lead("day").over(order).alias("next_day")
        )
        # A trading day's rank holds for every day up to the next trading day.
        held = F.array_repeat("rank", F.coalesce(F.datediff("next_day", "day"), F.lit(1)))
        folded = days.agg(
            F.min("day").alias("first"),
            F.max("day").alias("last"),
            F.array_sort(F.collect_list(F.struct("day", held.alias("held")))).alias("runs"),
        )
        passed = F.flatten(F.transform("runs", lambda run: run["held"]))
        self._value = folded.select(F.struct("first", "last", passed.alias("passed"))).scalar()

    def attach(self, df: DataFrame, name: str = "_calendar") -> DataFrame:
        """Add the calendar value as a column, to be used by the methods below and dropped."""
        return df.withColumn(name, self._value)

    @staticmethod
    def open_until(day: Column, name: str = "_calendar") -> Column:
        """Trading days up to and including ``day``; constant outside the calendar."""
        known = F.col(name)
        position = F.datediff(F.least(day, known["last"]), known["first"]) + 1
        return F.when(day < known["first"], 0).otherwise(F.get(known["passed"], position - 1))

    @classmethod
    def closed_between(cls, start: Column, end: Column, name: str = "_calendar") -> Column:
        """Days without trading from ``start`` to ``end``, both included."""
        span = F.datediff(end, start) + 1
        opened = cls.open_until(end, name) - cls.open_until(F.date_sub(start, 1), name)
        return F.when(end >= start, span - opened).otherwise(0)

    @classmethod
    def gap(cls, start: Column, end: Column, first=None, last=None, name: str = "_calendar") -> Column:
        """Business days strictly between two dates.

        ``datediff - 1`` less the closed days from start to end inclusive; closed
        days count only inside ``first``..``last`` when that window is given.
        """
        low = start if first is None else F.greatest(start, first)
        high = end if last is None else F.least(end, last)
        return F.datediff(end, start) - 1 - cls.closed_between(low, high, name)


def business_days_between(
    df: DataFrame, start: str, end: str, calendar: DataFrame, first=None, last=None, out: str = "business_days"
) -> DataFrame:
    """``df`` with the business-day gap of two of its date columns."""
    window = [None if bound is None else C.as_date(bound) for bound in (first, last)]
    days = BusinessDays(calendar)
    return days.attach(df).withColumn(out, days.gap(F.col(start), F.col(end), *window)).drop("_calendar")
