"""Odometer readings: units, bounds and readings in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions.numbers import half_up
from vinlake.functions.once import bound

# Fixed values.
MILES_PER_KM = 0.621371
LEAST, MOST = 1, 2_000_000
_NUMBER = r"(\d{1,3}(?:,\d{3}){1,2}|\d{2,7})"
TEXT_FORMS = (
    rf"(?i){_NUMBER}\s*(?:k\.?m\.?|kilometers?|kilometres?)(?![A-Za-z0-9_])",
    rf"(?i){_NUMBER}\s*(?:mi\.?|miles?)(?![A-Za-z0-9_])",
    rf"(?iu)(?:odometer|mileage|주행거리)\s*[:.]?\s*{_NUMBER}(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])(\d{4,7})km(?![A-Za-z0-9_])",
)


def usable(x: Column) -> Column:
    """Above 1 and at most two million; false for null."""
    return F.coalesce((x > LEAST) & (x <= MOST), F.lit(False))


def is_miles(unit: Column) -> Column:
    return F.coalesce(F.lower(unit).isin("mi", "mile", "miles"), F.lit(False))


def to_km(x: Column, unit: Column) -> Column:
    """Whole kilometres of a reading in its unit; other units than miles are kilometres."""
    return F.when(is_miles(unit), half_up(x / MILES_PER_KM)).otherwise(half_up(x.cast("double")))


def to_miles(km: Column) -> Column:
    return half_up(km * MILES_PER_KM)


def in_text(text: Column) -> Column:
    """The first usable reading that a text states, by the forms in order, as written (no unit applied)."""
    # Each form is tried once, and only while those before it found nothing. A cast that fails costs far more than one that is not tried.
    number = lambda x: F.when(x != "", F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    found = (bound(bound(F.regexp_extract(text, form, 1), number), lambda x: F.when(usable(x), x)) for form in TEXT_FORMS)
    return F.when(text.rlike("[0-9]"), F.coalesce(*found))


def coerce(raw: Column) -> Column:
    """A reading in a text of any form: a stated one, else the digits that are left."""
    left = F.nullif(F.regexp_replace(raw, r"[^\d.]", ""), F.lit("")).try_cast("double")
    return F.coalesce(in_text(raw), F.when(usable(left), half_up(left).cast("double")))
