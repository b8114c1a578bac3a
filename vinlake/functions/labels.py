"""Fuel, model, engine and title labels."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions.numbers import tidy

# The first pattern that fits decides. A word's edge is anything but an ASCII letter, digit or underscore, on both engines alike.
_A, _Z = r"(?:^|[^A-Za-z0-9_])", r"(?:$|[^A-Za-z0-9_])"
FUEL_RULES = (
    (r"plug[\s-]?in|phev|hybryda\s*plug", "Plug-in Hybrid"),
    (rf"gas\s*/\s*electric|gasoline\+electric|petrol\+electric|hybrid\s*petrol|hybrid\s*engine|mhev|hev{_Z}", "Hybrid"),
    (rf"{_A}hybrid{_Z}", "Hybrid"),
    (rf"diesel|nafta|motorina|gasolio|gas[oó]leo|дизел|디젤|light\s*oil|tdi{_Z}|cdi{_Z}|hdi{_Z}|dci{_Z}|crdi{_Z}", "Diesel"),
    (rf"electricit|electric|{_A}ev{_Z}|elektro|elektr|електр", "Electric"),
    (r"hydrogen|wasserstoff|vod[ií]k|fuel\s*cell", "Hydrogen"),
    (rf"{_A}lpg{_Z}|autogas|{_A}gpl{_Z}|gasoline\+lpg|petrol\+lpg|пропан|propan", "LPG"),
    (rf"{_A}cng{_Z}|erdgas|metano|zemní\s*plyn|zemny\s*plyn|natural\s*gas|compressed\s*natural", "CNG"),
    (r"flex(?:ible)?(?:\s*fuel)?|e85|ethanol", "Flex Fuel"),
    (rf"benz[ií]n|petrol|gasoline|gasolina|benzin|benzina|essence|бензин|{_A}gas{_Z}", "Gasoline"),
    (r"гибрид", "Hybrid"),
    (r"дизел", "Diesel"),
    (r"other|unsure|unknown|n/a|gaseous\s*powered", "Other"),
)
MODEL_CLASSES = ("A", "B", "C", "E", "S", "G", "CLA", "CLS", "GLA", "GLB", "GLC", "GLE", "GLS", "EQA", "EQB", "EQC", "EQE", "EQS", "AMG")


def fuel(raw: Column) -> Column:
    """The canonical fuel of a text; null if it has none."""
    text, out = tidy(raw), F.lit(None).cast("string")
    for pattern, label in reversed(FUEL_RULES):
        out = F.when(text.rlike(f"(?iu){pattern}"), label).otherwise(out)
    return out


def model(raw: Column) -> Column:
    """A model's display form: 5er, 5-series and 5 Series are one, as are c class and C-Class. Blank gives null."""
    s = F.nullif(tidy(raw), F.lit(""))
    s = F.regexp_replace(s, r"(?i)\b(\d)\s*[-_/]?\s*series\b", "$1 Series")
    s = F.regexp_replace(s, r"(?i)\b(\d)\s*[-_/]?\s*er\b", "$1 Series")
    for name in sorted(MODEL_CLASSES, key=len, reverse=True):
        s = F.regexp_replace(s, rf"(?i)\b{name}\s*[-_/]?\s*class\b", f"{name}-Class")
    return s


def model_spellings(selected: str) -> list[str]:
    """Lower-case spellings of a model that a filter on it should accept."""
    name = " ".join(selected.split())
    number = re.fullmatch(r"(?i)(\d)\s*[-_/]?\s*(series|er)", name)
    letters = re.fullmatch(r"(?i)([a-z]{1,3})\s*[-_/]?\s*class", name)
    if number:
        d = number[1]
        return sorted({name.lower(), *(d + x for x in (" series", "-series", "series", "er", " er", "-er"))})
    if letters and letters[1].upper() in MODEL_CLASSES:
        c = letters[1].lower()
        return sorted({name.lower(), *(c + x for x in ("-class", " class", "class"))})
    return [name.lower()] if name else []


def engine_cc(raw: Column) -> Column:
    """Cubic centimetres of a displacement: below 20 it is litres. Null if there is no number."""
    x = F.nullif(F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(x < 20, F.floor(x * 1000 + 0.5).cast("long")).otherwise(F.floor(x + 0.5).cast("long"))


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")


def english_only(raw: Column, rules: tuple[tuple[str, str], ...], most: int = 40) -> Column:
    """A label by ordered patterns; without one, the text itself if it is plain ASCII and at most `most` characters, else null."""
    text, out = tidy(raw), F.when(~tidy(raw).rlike(r"[^\x00-\x7F]") & (F.length(tidy(raw)) <= most), tidy(raw))
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(f"(?iu){pattern}"), label).otherwise(out)
    return F.nullif(out, F.lit(""))


# Fixed values.
TRANSMISSION_RULES = ((r"автомат|automat|오토", "Automatic"), (r"механ|manual|수동", "Manual"), (r"робот|robot|dct|dsg", "Automated"), (r"вариатор|cvt", "CVT"))
DRIVE_RULES = ((r"полн|4wd|awd|4x4|quattro|xdrive|all.wheel", "AWD"), (r"передн|fwd|front", "FWD"), (r"задн|rwd|rear", "RWD"))


def title_parts(title: Column, makes: list[str]) -> tuple[Column, Column, Column]:
    """(year, make, model) that a listing's title states: a year from 1980 to 2035, the longest of `makes` that it begins with (after the year), and the next word that
    is neither junk nor a machine-made token."""
    text = tidy(title)
    year = F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])((?:19|20)\d{2})(?:$|[^0-9])", 1), F.lit("")).try_cast("int")
    rest = tidy(F.regexp_replace(text, r"(?:^|(?<=[^0-9]))(?:19|20)\d{2}(?=$|[^0-9])", " "))
    names = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(name.lower() + " ").alias("start")) for name in reversed(sorted(makes, key=len))))
    named = lambda low: F.get(F.filter(names, lambda n: F.startswith(low, n["start"])), F.lit(0))["name"] if makes else F.lit(None).cast("string")
    parts = _bound(rest, lambda r: F.struct(r.alias("rest"), _bound(F.concat(F.lower(r), F.lit(" ")), named).alias("make")))
    words = lambda s: F.split(tidy(F.substr(s["rest"], F.length(s["make"]) + 1)), " ")
    good = lambda w: (w != "") & ~w.rlike(r"(?i)^(?:[0-9a-f]{8}-[0-9a-f-]{20,}|n/?a|unknown|null|undefined|used|car|for|sale)$")
    model = _bound(parts, lambda s: F.when(s["make"].isNotNull(), F.get(F.filter(words(s), good), F.lit(0))))
    return F.when(year.between(1980, 2035), year), parts["make"], model


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
