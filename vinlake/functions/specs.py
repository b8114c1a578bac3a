"""Specification values: stand-ins dropped, displacements cleaned, page debris and foreign scripts mapped or removed, chassis and trim read from titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.functions.numbers import tidy

# Fixed values.
STAND_INS = r"^(?:0+|n/?a|n\.a\.?|null|undefined|unknown|unspecified|not\s*specified|none|others?|unspecific|-+|—|\.|car|vehicle|auto|tbd|nil)$"
DEBRIS = r"Цена|Топливо|объявлен|Доставка|Бренды|Привод"
DRIVES = ((r"полн|awd|4wd|4x4|all.?wheel", "AWD"), (r"передн|fwd|front|2\s*wd", "FWD"), (r"задн|rwd|rear", "RWD"))
TRANSMISSIONS = ((r"автомат|automat", "Automatic"), (r"механ|manual", "Manual"), (r"робот|robot", "Automated"), (r"вариатор|cvt", "CVT"))
MOST = 24


def value(raw: Column) -> Column:
    """A tidy value; stand-ins for none are null."""
    text = F.nullif(tidy(raw), F.lit(""))
    return F.when(~text.rlike(f"(?i){STAND_INS}"), text)


def displacement(raw: Column) -> Column:
    """A tidy displacement; null without a number above 0."""
    text = F.nullif(tidy(raw), F.lit(""))
    return F.when(F.nullif(F.regexp_replace(text, r"[^\d.]", ""), F.lit("")).try_cast("double") > 0, text)


def english(raw: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern that a short value without page debris fits; else null if it holds Cyrillic, debris or more than MOST characters; else the value."""
    text = value(raw)
    clean = ~text.rlike(DEBRIS)
    out = F.when(text.rlike("[А-Яа-яЁё]") | ~clean | (F.length(text) > MOST), F.lit(None)).otherwise(text)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(f"(?iu){pattern}") & clean & (F.length(text) < MOST), label).otherwise(out)
    return out


def chassis_code(title: Column) -> Column:
    """The generation that a title names: in parentheses as (F10), or as a word such as W213; in capitals, null without."""
    body = F.regexp_replace(tidy(title), r"^\[[^\]]+\]\s*", "")
    found = F.coalesce(F.nullif(F.regexp_extract(body, r"\(([A-Za-z]\d{2}[A-Za-z]?)\)", 1), F.lit("")), F.nullif(F.regexp_extract(body, r"(?i)\b((?:W|C|V|X|A)\d{3})\b", 1), F.lit("")))
    return F.upper(found)


def trim_after_code(title: Column) -> Column:
    """What a title says after its generation; null without."""
    body = F.regexp_replace(tidy(title), r"^\[[^\]]+\]\s*", "")
    rest = F.coalesce(F.nullif(F.regexp_extract(body, r"\([A-Za-z]\d{2}[A-Za-z]?\)(.*)$", 1), F.lit("")), F.nullif(F.regexp_extract(body, r"(?i)\b(?:W|C|V|X|A)\d{3}\b(.*)$", 1), F.lit("")))
    return F.nullif(F.regexp_replace(F.trim(rest), r"^[\s\-–—|/.,]+", ""), F.lit(""))


def trim_remainder(title: Column, year: Column, make: Column, model: Column) -> Column:
    """What is left of a title after its year, make and model in that order; null if nothing or only marks."""
    rest = tidy(title)
    rest = F.when(F.startswith(rest, F.concat(year.cast("string"), F.lit(" "))), F.substr(rest, F.lit(6))).otherwise(F.when(year.isNull(), F.regexp_replace(rest, r"^(?:19|20)\d{2}\s+", "")).otherwise(rest))
    for part in (make, model):
        hit = F.startswith(F.lower(rest), F.concat(F.lower(part), F.lit(" ")))
        rest = F.when(F.coalesce(hit, F.lit(False)), F.ltrim(F.substr(rest, F.length(part) + 1))).otherwise(rest)
    return F.when(~rest.rlike(r"^[-–—.?]*$"), rest)


def translated(df: DataFrame, column: str, words: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a column translated by a dictionary (word, meaning): whole values by their lower-case form; others stay. The dictionary is broadcast only if it is counted
    to have at most most_rows words."""
    d = words.select(F.lower(F.trim("word")).alias("_w"), "meaning").dropDuplicates(["_w"])
    d = F.broadcast(d) if d.limit(most_rows + 1).count() <= most_rows else d
    return df.join(d, F.lower(F.trim(column)) == F.col("_w"), "left").withColumn(column, F.coalesce("meaning", column)).drop("_w", "meaning")
