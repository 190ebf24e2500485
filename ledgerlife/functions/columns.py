"""Scalar and array expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlife.functions import codes


def as_column(value) -> Column:
    """A column from a name or a column."""
    return value if isinstance(value, Column) else F.col(value)


def as_date(value) -> Column:
    """A date column from a date, ISO text or a column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def date_list(values: Iterable) -> Column:
    return F.array(*[as_date(v) for v in values])


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded; null where the whole is zero."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def lookup(value: Column, table: Mapping, default) -> Column:
    """CASE over a small fixed table; nulls and unknown values take the default."""
    out = None
    for key, mapped in table.items():
        out = F.when(value == key, F.lit(mapped)) if out is None else out.when(value == key, F.lit(mapped))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def age_years(birthdate: Column, as_of: Column, digits: int | None = None) -> Column:
    years = F.datediff(as_of, birthdate) / F.lit(365.0)
    return years if digits is None else F.round(years, digits)


def age_bucket(age: Column) -> Column:
    """1 up to 35, 2 up to 45, 3 above or unknown."""
    return F.when(age <= 35, 1).when(age <= 45, 2).otherwise(3)


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower (not per word, as ``initcap`` would)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def income_bucket(text: Column) -> Column:
    return lookup(text, codes.INCOME_ORDINALS, 0)


def risk_ordinal(text: Column) -> Column:
    return lookup(text, codes.RISK_ORDINALS, 0)


def gender_label(text: Column) -> Column:
    return F.when(text == "f", "F").otherwise(text)


def gender_flag(text: Column) -> Column:
    return F.when(gender_label(text) == "F", 1).otherwise(0)


def gap_label(days: Column) -> Column:
    """Label of a mean gap in days; no gap yet falls into the last label."""
    out = None
    for label, limit in codes.GAP_LABEL_DAYS.items():
        out = F.when(days <= limit, label) if out is None else out.when(days <= limit, label)
    return out.otherwise(codes.GAP_LABEL_OTHER)


def gap_label_days(label: Column) -> Column:
    return lookup(label, codes.GAP_LABEL_DAYS, codes.GAP_LABEL_OTHER_DAYS)


def bucket_label(bounds: tuple) -> str:
    return f"{bounds[0]}-{bounds[1]}"


def inactivity_bucket(days: Column, buckets=None) -> Column:
    """Bucket text; whatever no earlier bucket holds goes to the last one."""
    buckets = buckets or codes.INACTIVITY_BUCKETS
    out = None
    for bounds in buckets[:-1]:
        hit = days.between(*bounds)
        out = F.when(hit, bucket_label(bounds)) if out is None else out.when(hit, bucket_label(bounds))
    last = bucket_label(buckets[-1])
    return F.lit(last) if out is None else out.otherwise(last)


def settle_target(target_days: Column) -> Column:
    """0 stayed at the first trade, 1 settling (2-3 days), 2 frequent."""
    return F.when(target_days == 1, 0).when(target_days.isin(2, 3), 1).when(target_days > 3, 2)


def frequent_target(target_days: Column, trade_days: Column) -> Column:
    """1 frequent, 0 still settling after more than one day, null otherwise."""
    return F.when(target_days > 3, 1).when(target_days.isin(2, 3) & (trade_days > 1), 0)


def event_within(days: Column, limit: int = 90) -> Column:
    """1 when the event came within the limit; null counts as not observed."""
    return F.when(days <= limit, 1).otherwise(0)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def to_number(text: Column) -> Column:
    """Double, or null where the text is no number (also in ANSI mode)."""
    return text.try_cast("double")


def nan_or_null_to(value: Column, default: float) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(default))


def non_blank(items: Column) -> Column:
    """The array without null and empty elements; a null array stays null."""
    return F.filter(items, lambda item: item != "")


def item_count(items: Column) -> Column:
    return F.array_size(items)


def row_mean(*values: Column) -> Column:
    total = values[0]
    for value in values[1:]:
        total = total + value
    return total / F.lit(float(len(values)))


def row_stddev(*values: Column) -> Column:
    """Sample standard deviation across columns of one row."""
    mean = row_mean(*values)
    squares = None
    for value in values:
        term = (value - mean) * (value - mean)
        squares = term if squares is None else squares + term
    return F.sqrt(squares / F.lit(float(len(values) - 1)))


def power(base: Column, exponent: Column) -> Column:
    return F.pow(base, exponent)


def constants(values, kind: str) -> str:
    """A constant array as SQL, written as one text that Spark folds to a literal; code made for it doesn't change with the values."""
    return f"CAST(split('{','.join(repr(v) for v in values)}', ',') AS array<{kind}>)"
