"""Countries: one name for codes and spellings, slugs, and sets of markets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, then the spellings in lower case that mean it.
COUNTRIES = {
    "South Korea": ("kr", "kor", "korea", "s korea", "south korea", "republic of korea", "rok"),
    "United States": ("us", "usa", "united states", "united states of america", "america"),
    "Canada": ("ca", "can", "canada"),
    "United Arab Emirates": ("ae", "uae", "united arab emirates"),
    "Saudi Arabia": ("sa", "sau", "ksa", "saudi", "saudi arabia"),
    "Norway": ("no", "nor", "norway", "norge"),
    "Finland": ("fi", "fin", "finland", "suomi"),
    "United Kingdom": ("gb", "uk", "united kingdom", "great britain"),
    "Georgia": ("ge", "geo", "georgia"),
    "Germany": ("de", "deu", "germany", "deutschland", "allemagne"),
    "France": ("fr", "fra", "france", "frankreich"),
    "Poland": ("pl", "pol", "poland", "polska"),
    "Austria": ("at", "aut", "austria", "österreich", "osterreich"),
    "Europe": ("eu", "europe"),
    "Japan": ("jp", "jpn", "japan"),
    "China": ("cn", "chn", "china", "people's republic of china", "prc"),
    "Albania": ("al", "albania"),
    "Montenegro": ("me", "montenegro", "crna gora"),
    "Serbia": ("rs", "serbia", "srbija"),
    "North Macedonia": ("mk", "macedonia", "north macedonia"),
    "Bosnia and Herzegovina": ("ba", "bosnia", "bosnia and herzegovina"),
    "Kosovo": ("xk", "kosovo"),
    "Romania": ("ro", "romania", "românia"),
    "Croatia": ("hr", "croatia", "hrvatska"),
    "Slovenia": ("si", "slovenia", "slovenija"),
    "Slovakia": ("sk", "svk", "slovakia", "slovak republic", "slovensko"),
    "Czechia": ("cz", "cze", "czech", "czechia", "czech republic", "cesko", "česko"),
    "Hungary": ("hu", "hun", "hungary", "magyarország", "magyarorszag"),
    "Italy": ("it", "ita", "italy", "italia"),
    "Spain": ("es", "esp", "spain", "españa", "espana"),
    "Netherlands": ("nl", "nld", "netherlands", "holland", "nederland"),
    "Belgium": ("be", "bel", "belgium", "belgië", "belgie", "belgique"),
    "Portugal": ("pt", "prt", "portugal"),
    "Bulgaria": ("bg", "bgr", "bulgaria"),
    "Switzerland": ("ch", "che", "switzerland", "schweiz", "suisse", "svizzera"),
    "Greece": ("gr", "greece"),
    "Turkey": ("tr", "turkey", "türkiye", "turkiye"),
    "Armenia": ("am", "armenia"),
    "Azerbaijan": ("az", "azerbaijan"),
}
EXPORT_DESTINATIONS = (
    "Georgia", "Albania", "Montenegro", "Serbia", "North Macedonia", "Bosnia and Herzegovina", "Kosovo", "Bulgaria", "Romania", "Croatia", "Slovenia", "Slovakia", "Greece", "Turkey",
    "Armenia", "Azerbaijan", "United Arab Emirates", "Saudi Arabia", "Poland", "Austria", "Europe", "Norway", "Finland",
)
TRUSTED_ORIGINS = (
    "United States", "Canada", "Japan", "Saudi Arabia", "Germany", "France", "United Kingdom", "Poland", "Austria", "Norway", "Finland", "Slovakia", "Czechia", "Hungary", "Italy", "Spain",
    "Netherlands", "Belgium", "Portugal", "Bulgaria", "Switzerland", "Slovenia",
)


def key(raw: Column) -> Column:
    """How spellings are looked up: lower case, _ as a space, no points, single spaces."""
    return F.regexp_replace(F.replace(F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit(" ")), F.lit("."), F.lit("")), r"\s+", " ")


def country(raw: Column) -> Column:
    """The one name of a country; an unknown one is only trimmed, a blank one null."""
    table = F.create_map(*(F.lit(x) for name, spellings in COUNTRIES.items() for s in spellings for x in (s, name)))
    text = F.trim(raw)
    return F.when(text != "", F.coalesce(F.element_at(table, key(raw)), text))


def slug(raw: Column) -> Column:
    """The name in lower case with _ for each run of other characters, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(country(raw)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def spellings(selected: str) -> list[str]:
    """Lower-case spellings that a filter on a country should accept."""
    name = " ".join(selected.strip().lower().replace("_", " ").replace(".", "").split())
    for canonical, known in COUNTRIES.items():
        if name in known or name == canonical.lower():
            return sorted({canonical.lower(), *known})
    return [selected.strip().lower()]


def origin(now: Column, incoming: Column) -> Column:
    """A vehicle's country after another source: a South Korea that was only assumed gives way to a trusted origin, and export destinations never replace one."""
    a, b = country(now), country(incoming)
    return F.when(a.isNull(), b).when((a == "South Korea") & b.isin(*TRUSTED_ORIGINS), b).otherwise(a)


def without_country(place: Column, name: Column) -> Column:
    """A place without ", <country>" at its end."""
    return F.when(F.endswith(F.lower(place), F.concat(F.lit(", "), F.lower(name))), F.substr(place, F.lit(1), F.length(place) - F.length(name) - 2)).otherwise(place)
