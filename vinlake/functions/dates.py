"""Dates in many forms, and which of them are believable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(raw: Column) -> Column:
    """yyyy-mm-dd at the start of a text, or yyyymmdd as a whole, as text; else null."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10)).when(raw.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)))


def day_of(ts: Column) -> Column:
    """The UTC day of a timestamp, as text."""
    return F.date_format(ts, "yyyy-MM-dd")


def short_day(raw: Column) -> Column:
    """yymmdd or yyyymmdd as a date; two-digit years from 70 on are of the last century."""
    two = F.regexp_extract(raw, r"^(\d{2})(\d{2})(\d{2})$", 0)
    century = F.when(F.substring(two, 1, 2).try_cast("int") >= 70, "19").otherwise("20")
    whole = F.when(two != "", F.concat(century, two)).otherwise(F.nullif(F.regexp_extract(raw, r"^\d{8}$", 0), F.lit("")))
    return F.to_date(F.try_to_timestamp(whole, F.lit("yyyyMMdd")))


def reasonable(ts: Column, as_of: Column) -> Column:
    """From 1990 on and at most 120 days ahead; false for null."""
    return F.coalesce((ts >= F.lit("1990-01-01").cast("timestamp_ntz")) & (ts <= as_of + F.expr("INTERVAL 120 DAYS")), F.lit(False))


def earlier(a: Column, b: Column, as_of: Column) -> Column:
    """The earlier of two dates, unbelievable ones not counted."""
    return F.least(F.when(reasonable(a, as_of), a), F.when(reasonable(b, as_of), b))


def later(a: Column, b: Column, as_of: Column) -> Column:
    return F.greatest(F.when(reasonable(a, as_of), a), F.when(reasonable(b, as_of), b))


def from_object_id(raw: Column) -> Column:
    """When a 24-digit hexadecimal object id was made: its first 8 digits are seconds."""
    return F.when(raw.rlike("(?i)^[a-f0-9]{24}$"), F.timestamp_seconds(F.conv(F.substring(raw, 1, 8), 16, 10).cast("long")).cast("timestamp_ntz"))


def from_item_code(raw: Column) -> Column:
    """The date in an item code such as CIyyyymmdd..., at its start."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(raw, r"(?i)^CI(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("timestamp_ntz")


def from_goods_id(raw: Column) -> Column:
    """The date in a goods id such as PTyymmdd-..., at its start."""
    return short_day(F.nullif(F.regexp_extract(raw, r"(?i)^PT(\d{6})(?:-|$)", 1), F.lit(""))).cast("timestamp_ntz")


def precision(value: Column) -> Column:
    """day, month or year, by the form of a date's text; else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), "day").when(value.rlike(r"^\d{4}-\d{2}$"), "month").when(value.rlike(r"^\d{4}$"), "year")
