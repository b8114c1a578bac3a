"""Rounding and number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity, as a long."""
    return F.floor(x + 0.5).cast("long")


def cents(x: Column) -> Column:
    """Nearest hundredth, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def share_percent(part: Column, whole: Column) -> Column:
    """Whole percent of a total; null if the total is 0."""
    return F.when(whole > 0, half_up(part / whole * 100))


def tidy(text: Column) -> Column:
    """Text with runs of white space (no-break spaces too) as one space and none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x{00A0}]+", " "), r"^ | $", "")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(tidy(text), F.lit(""))


def plain_number(text: Column) -> Column:
    """Text that is a number as a double, else null."""
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).try_cast("double"))


def digits_number(text: Column) -> Column:
    """The number that is left of a text without all but digits and points; null if none or not above 0."""
    left = F.nullif(F.regexp_replace(text, r"[^\d.]", ""), F.lit("")).try_cast("double")
    return F.when(left > 0, left)


def text_of_number(x: Column) -> Column:
    """A number as people write it: whole ones without a point. Null gives an empty text."""
    return F.coalesce(F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")), F.lit(""))
