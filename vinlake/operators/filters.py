"""Conditions that are put together from optional parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions import geo, labels
from vinlake.functions.money import effective_usd


@dataclass(frozen=True)
class Search:
    """Vehicle search: every parameter may be left out."""

    search: str | None = None
    make: str | None = None
    model: str | None = None
    fuel: str | None = None
    country: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    usd_from: float | None = None
    usd_to: float | None = None
    provider: int | None = None


def by_dimension(s: Search) -> dict[str, Column]:
    """Conditions on vehicle columns, by the dimension that they limit; only those that the search gives."""
    out: dict[str, Column] = {}
    if s.search:
        q = s.search.strip()
        if re.fullmatch(r"(?i)[A-HJ-NPR-Z0-9]{11,17}", q):  # shaped like an identifier: a prefix, which a scan can skip by
            out["search"] = F.startswith(F.col("vin"), F.lit(q.upper()))
        else:
            out["search"] = reduce(Column.__or__, (F.contains(F.lower(c), F.lit(q.lower())) for c in ("vin", "make", "model")))
    if s.make:
        out["make"] = F.lower("make") == s.make.lower()
    if s.model:
        out["model"] = F.lower("model").isin(labels.model_spellings(s.model))
    if s.fuel:
        out["fuel"] = labels.fuel(F.col("fuel_type")) == s.fuel
    if s.country:
        out["country"] = geo.key(F.col("country")).isin(geo.spellings(s.country))
    years = ([F.col("year") >= s.year_from] if s.year_from is not None else []) + ([F.col("year") <= s.year_to] if s.year_to is not None else [])
    return out | ({"year": reduce(Column.__and__, years)} if years else {})


def vehicle_conditions(s: Search, omit: str | None = None) -> Column:
    """All of them, with one dimension left out for its own facet. Prices and providers stand on listings and are not among them."""
    return reduce(Column.__and__, (c for d, c in by_dimension(s).items() if d != omit), F.lit(True))


def listing_conditions(s: Search) -> Column | None:
    """Conditions on a listing, for a semi-join (F8, J3, J4); None if there are none."""
    usd, parts = effective_usd(F.lit(None).cast("double"), F.col("price_amount"), F.col("price_currency")), []
    parts += [F.col("provider_id") == s.provider] if s.provider is not None else []
    parts += [usd >= s.usd_from] if s.usd_from is not None else []
    parts += [usd <= s.usd_to] if s.usd_to is not None else []
    return reduce(Column.__and__, parts) if parts else None


def status_class(status: Column, name: str) -> Column:
    """2xx, 4xx, 5xx, errors (400 and above) or all."""
    return {"2xx": status.between(200, 299), "4xx": status.between(400, 499), "5xx": status >= 500, "errors": status >= 400}.get(name, F.lit(True))


def missing(*names: str) -> Column:
    """The names of columns that are null or blank, as an array."""
    return F.filter(F.array(*(F.when(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == ""), n) for n in names)), lambda x: x.isNotNull())


def within(ts: Column, as_of: str, length: str) -> Column:
    """Later than `length` (such as "24 HOURS") before as_of."""
    return ts > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {length}")


@dataclass(frozen=True)
class LiveSearch:
    """A search over live feeds: every parameter may be left out. texts: column to the text that it must hold."""

    search: str | None = None
    make: str | None = None
    model: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    mileage_from: float | None = None
    mileage_to: float | None = None
    engine_from: int | None = None
    engine_to: int | None = None
    usd_from: float | None = None
    usd_to: float | None = None
    texts: Mapping[str, str] = field(default_factory=dict)


def engine_between(raw: Column, low: int | None, high: int | None) -> Column:
    """Whether a displacement lies in a range of cubic centimetres (F20); an unknown one doesn't."""
    cc = labels.engine_cc(raw)
    return F.coalesce(cc >= (0 if low is None else low), F.lit(False)) & (F.lit(True) if high is None else F.coalesce(cc <= high, F.lit(False)))


def live_conditions(s: LiveSearch, columns: Sequence[str]) -> Column:
    """The combined filter that feeds are held to again after their union (F19), over the columns that they have: make, model, model_group, trim, badge, year, mileage,
    engine_displacement, usd and those of texts. A null year counts as 0 for the least and as endless for the greatest, a null mileage likewise; a null displacement or
    price is in no range."""
    have = lambda c: F.coalesce(F.lower(F.col(c)), F.lit("")) if c in columns else F.lit("")
    hold = lambda where, what: F.contains(where, F.lit(what.lower()))
    hay = F.concat_ws(" ", *(have(c) for c in ("make", "model", "model_group", "trim")))
    names = [have(c) for c in ("model_group", "model", "trim", "badge") if c in columns]

    def model(want: str) -> Column:
        spelt = labels.model_spellings(want)
        return reduce(Column.__or__, ((n != "") & (reduce(Column.__or__, (F.contains(n, F.lit(x)) for x in spelt), F.lit(False)) | F.contains(F.lit(want.lower()), n)) for n in names), F.lit(False))

    out = [F.lit(True)]
    for c, low, high in (("year", s.year_from, s.year_to), ("mileage", s.mileage_from, s.mileage_to)):
        out += [F.coalesce(c, F.lit(0)) >= low] if low is not None else []
        out += [F.coalesce(F.col(c) <= high, F.lit(False))] if high is not None else []
    out += [engine_between(F.col("engine_displacement"), s.engine_from, s.engine_to)] if s.engine_from is not None or s.engine_to is not None else []
    out += [hold(hay, s.make)] if s.make else []
    out += [model(s.model)] if s.model else []
    out += [hold(have(c), what) for c, what in sorted(s.texts.items())]
    out += [hold(F.concat_ws(" ", hay, *(have(c) for c in ("location", "vin", "listing_id"))), s.search) | model(s.search)] if s.search else []
    out += [F.coalesce(F.col("usd") >= s.usd_from, F.lit(False))] if s.usd_from is not None else []
    out += [F.coalesce(F.col("usd") <= s.usd_to, F.lit(False))] if s.usd_to is not None else []
    return reduce(Column.__and__, out)
