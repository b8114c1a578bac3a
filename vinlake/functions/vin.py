"""Vehicle identifiers: normal forms, check digits, chassis numbers and identifiers in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions.once import bound

# What each letter counts in a check digit, and the weight of each place.
LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
LETTER_VALUES = "12345678123457923456789"
WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def clean(raw: Column) -> Column:
    """Capitals and digits without I, O and Q; all else goes."""
    return F.regexp_replace(F.upper(raw), r"[^A-HJ-NPR-Z0-9]", "")


def _shaped(vin: Column) -> Column:
    """17 characters, not one repeated, no digit nine times or more at the end, and some letter."""
    return (F.length(vin) == 17) & ~vin.rlike(r"^(.)\1{16}$") & ~vin.rlike(r"(\d)\1{8,}$") & ~vin.rlike(r"^\d+$")


def labelled_vin(raw: Column) -> Column:
    """The identifier of a field that is named as one: any ninth character."""
    vin = clean(raw)
    return F.when(_shaped(vin), vin)


def vin(raw: Column) -> Column:
    """The identifier whose ninth character is a digit or X, else null."""
    found = clean(raw)
    return F.when(_shaped(found) & F.substring(found, 9, 1).rlike("[0-9X]"), found)


def check_digit(vin: Column) -> Column:
    """The ninth character that the other sixteen ask for; null if a character has no value or there are not 17."""

    def total(values: Column) -> Column:
        return reduce(Column.__add__, (F.substring(values, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS) if w)) % 11

    def digit(vin: Column) -> Column:
        rest = bound(F.translate(vin, LETTERS, LETTER_VALUES), total)
        return F.when((F.length(vin) == 17) & vin.rlike("^[A-HJ-NPR-Z0-9]{17}$"), bound(rest, lambda r: F.when(r == 10, "X").otherwise(r.cast("string"))))

    return bound(vin, digit)


def check_digit_ok(vin: Column) -> Column:
    """Whether the ninth character is the check digit; false where there is none."""
    # The place itself has weight 0, but a letter there must have a value all the same: X has.
    return F.coalesce(F.substring(vin, 9, 1) == check_digit(vin), F.lit(False))


def chassis(raw: Column) -> Column:
    """A domestic chassis number without its dashes; masked, unknown and model-only ones are null."""
    text = F.upper(F.trim(raw))
    pretty = F.regexp_replace(text, r"[^A-Z0-9-]", "")
    compact = F.replace(pretty, F.lit("-"), F.lit(""))
    good = (
        ~text.rlike(r"\*|ASK|N/A|UNKNOWN|--") & F.length(pretty).between(8, 24) & pretty.rlike("[A-Z]") & pretty.rlike(r"\d{4,}")
        & F.length(compact).between(10, 22) & ~compact.rlike(r"^(.)\1{9,}$")
    )
    return F.when(good, F.coalesce(F.when(F.length(compact) == 17, vin(compact)), compact))


def history_id(raw: Column) -> Column:
    """What a vehicle's history is kept under: identifier, labelled identifier, else chassis number."""
    return F.coalesce(vin(raw), labelled_vin(raw), chassis(raw))


def checkable(raw: Column) -> Column:
    """Whether a public check takes this: 5 to 17 letters and digits."""
    return F.upper(F.trim(raw)).rlike("^[A-Z0-9]{5,17}$")


def vins_in(text: Column) -> Column:
    """Identifiers with a right check digit that stand in a text as words, in order."""
    words = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-HJ-NPR-Z0-9]{17})\b"), 1)
    return F.filter(words, lambda w: vin(w).isNotNull() & check_digit_ok(w))


def wildcards(vin: Column, length: int = 17) -> Column:
    """The identifier with each place masked in turn: two of equal length that differ in one place share a mask."""
    return F.array(*(F.concat(F.substring(vin, 1, i), F.lit("?"), F.substring(vin, i + 2, length)) for i in range(length)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two texts of equal length differ; null for other lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda n, x: n + x))
