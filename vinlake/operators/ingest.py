"""Ingest: gates, fingerprints, append-only observations, clones, snapshot and vehicle merges, tombstones, synthesised and de-duplicated events.

Arrival order is a column, never the order of rows: each function is the same for any shuffle of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinlake.functions import dates, geo, meta
from vinlake.functions import mileage as M
from vinlake.functions import vin as V
from vinlake.functions.numbers import text_of_number, tidy
from vinlake.functions.text import looks_like_page
from vinlake.operators.joins import merge_duplicates
from vinlake.operators.projections import kept
from vinlake.operators.windows import first_per_key, richest_per_key

#: A payload is cut at this length, and an observation moves back in time only by more than a day.
MOST_RAW = 2 * 1024 * 1024
FIRST_REGISTRATION = r"(?i)first\s*registration|new\s*car\s*(?:delivery|shipment)"
TRUSTED_SOURCES = r"(?i)inspection|registry"


def status_key(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit(""))))


def fingerprint(vin: Column, provider: Column, price: Column, mileage: Column, status: Column, location: Column) -> Column:
    """SHA-256 of what makes an observation new, as hex (E1). Addresses, source ids and pictures don't count."""
    place = F.lower(tidy(F.coalesce(location, F.lit(""))))
    parts = [F.upper(F.trim(F.coalesce(vin, F.lit("")))), F.coalesce(provider.cast("string"), F.lit("")), text_of_number(price), text_of_number(mileage), status_key(status), place]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def gated(df: DataFrame, photos: int = 2, identifier: Callable[[Column], Column] = V.history_id) -> DataFrame:
    """df with gate_reason: the first gate that a listing fails (F17), null if it passes. Needs vin, mileage, make, model and usable_photos. identifier: what a vin is kept
    under, null if it is none."""
    reason = (
        F.when(identifier(F.col("vin")).isNull(), "vin").when(~M.usable(F.col("mileage")), "mileage")
        .when(F.coalesce(F.trim("make"), F.lit("")).isin("", "Unknown") | F.coalesce(F.trim("model"), F.lit("")).isin("", "Unknown"), "identity")
        .when(F.coalesce("usable_photos", F.lit(0)) < photos, "photos")
    )
    return df.withColumn("gate_reason", reason)


CONTENT = ("vehicle_id", "provider_id", "price_amount", "mileage", "status_key")


def appended(history: DataFrame, batch: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows of a batch that are new observations (E2, W4): not known by content (vehicle, provider, price, mileage, status; null equal to null), and the first in
    the order of each content. History and batch need the columns of CONTENT but status_key, and listing_status."""
    keyed = batch.withColumn("status_key", status_key(F.col("listing_status")))
    known = history.withColumn("status_key", status_key(F.col("listing_status"))).select(*(F.col(c).alias(f"_{c}") for c in CONTENT)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CONTENT]
    return first_per_key(keyed, CONTENT, order).join(known, same, "left_anti").drop("status_key")


def refreshed_dates(df: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """One row per key (E3, T6): listed is the earliest believable date, updated the latest, and observed_at moves back to the preferred date only if that is over a
    day earlier. Merges are by min and max, so late and repeated arrivals don't matter."""
    now = F.lit(as_of).cast("timestamp_ntz")
    ok = lambda c: F.when(dates.reasonable(F.col(c), now), F.col(c))
    one = df.groupBy(*keys).agg(F.min(ok("listed_at")).alias("listed_at"), F.max(ok("updated_at")).alias("updated_at"), F.min("observed_at").alias("observed_at"))
    preferred = F.coalesce("listed_at", "updated_at")
    return one.withColumn("observed_at", F.when(preferred + F.expr("INTERVAL 24 HOURS") < F.col("observed_at"), preferred).otherwise(F.col("observed_at")))


def observed_at(status: Column, sold: Column, listed: Column, modified: Column, now: Column) -> Column:
    """When an observation happened (E4): a sale's date, else listing date, else change date, else now; unbelievable dates are passed over."""
    ok = lambda c: F.when(dates.reasonable(c, now), c)
    return F.coalesce(F.when(F.lower(status) == "sold", ok(sold)), ok(listed), ok(modified), now)


def clone_ids(listings: DataFrame) -> DataFrame:
    """(id, keep): the oldest listing of the same provider, identifier, price and mileage (E5); identifiers under 10 characters and null ones have no clones."""
    long = F.length("vin") >= 10
    with_vin = merge_duplicates(listings.filter(long), ["provider_id", "vin", "price_amount", "mileage"])
    return with_vin.unionByName(listings.filter(~F.coalesce(long, F.lit(False))).select("id", F.col("id").alias("keep")))


def merged_snapshots(existing: DataFrame, batch: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Listing snapshots after a batch (E6): first_seen is the earliest, last_seen the latest, and of each field the value that came last and is not null. `order` ranks
    rows of both from old to new."""
    rows = existing.select(*keys, *fields, "seen_at", F.lit(0).alias("_new")).unionByName(batch.select(*keys, *fields, "seen_at", F.lit(1).alias("_new")))
    w = Window.partitionBy(*keys).orderBy("_new", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = Window.partitionBy(*keys).orderBy("_new", *order)
    found = rows.select(
        *keys, *(F.last(f, ignorenulls=True).over(w).alias(f) for f in fields), F.min("seen_at").over(w).alias("first_seen_at"), F.max("seen_at").over(w).alias("last_seen_at"),
        F.row_number().over(last).alias("_n"),
    )
    return found.filter("_n = 1").drop("_n")


def newest_vehicle(records: DataFrame, key: str, ts: str, fields: Sequence[str], ties: Sequence[str], km: str = "km", country: str = "country") -> DataFrame:
    """One row per vehicle from all its records (E7): of each field the newest value that is not blank, the largest odometer reading, and the country by the rule that
    an assumed South Korea gives way to a trusted origin. A fold in time order gives the same: a newer value replaces, an older one only fills. Records without a time
    of their own only fill gaps: a null time stands before all others."""
    stamp = F.struct(F.col(ts), *(F.col(t) for t in ties))
    filled = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
    named = geo.country(F.col(country))
    out = records.groupBy(key).agg(
        *(F.max_by(filled(f), F.when(filled(f).isNotNull(), stamp)).alias(f) for f in fields), F.max(F.when(M.usable(F.col(km)), F.col(km))).alias("current_km"), F.max(ts).alias("last_seen_at"),
        F.max_by(named, F.when(named.isNotNull(), stamp)).alias("_last"), F.max_by(named, F.when(named.isin(*geo.TRUSTED_ORIGINS), stamp)).alias("_trusted"),
    )
    return out.withColumn("country", F.when(F.col("_last") == "South Korea", F.coalesce("_trusted", "_last")).otherwise(F.col("_last"))).drop("_last", "_trusted")


def tombstones(known: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known active listings that a full crawl did not see, as inactive ones."""
    return known.join(seen.select(*keys).distinct(), list(keys), "left_anti").withColumns({"is_active": F.lit(False), "listing_status": F.lit("inactive")})


def sale_events(listings: DataFrame) -> DataFrame:
    """A sale event for each sold listing with a date and an amount (E9). Needs vehicle_id, listing_status, seen_at, price_amount and price_currency."""
    sold = listings.filter((status_key(F.col("listing_status")) == "sold") & F.col("seen_at").isNotNull())
    cur = F.coalesce("price_currency", F.lit("USD"))
    text = F.when(F.col("price_amount").isNotNull(), F.concat(F.lit("Sold for "), F.format_number("price_amount", 0), F.lit(" "), cur)).otherwise("Sold")
    fields = F.to_json(F.struct(F.col("price_amount").alias("priceAmount"), cur.alias("priceCurrency"), dates.day_of(F.col("seen_at")).alias("soldDate")))
    return sold.select("vehicle_id", F.lit("sale").alias("event_type"), text.alias("description"), fields.alias("metadata"), F.col("seen_at").alias("occurred_at"))


def distinct_events(events: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One event per vehicle, type, UTC day and description."""
    keyed = events.withColumns({"_day": F.to_date("occurred_at"), "_desc": F.md5(F.coalesce("description", F.lit("")).cast("binary"))})
    return first_per_key(keyed, ["vehicle_id", "event_type", "_day", "_desc"], order).drop("_day", "_desc")


def is_first_registration(kind: Column, desc: Column, m: Column) -> Column:
    """m: parsed metadata."""
    field = F.coalesce(meta.text(m, "field", "kind"), F.lit(""))
    return F.coalesce(field.isin("firstDate", "firstRegistration", "firstRegistrationDate") | ((F.lower(kind) == "delivery") & desc.rlike(FIRST_REGISTRATION)), F.lit(False))


def first_registration_score(value: Column, source: Column) -> Column:
    """How precise a first registration is (E11): a day 100, month 50, year 10, other text 5; a production year loses 40, a trusted source gains 25."""
    form = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), 100).when(value.rlike(r"^\d{4}-\d{2}$"), 50).when(value.rlike(r"^\d{4}$"), 10).when(value != "", 5).otherwise(0)
    return form - F.when(source == "productionYear", 40).otherwise(0) + F.when(source.rlike(TRUSTED_SOURCES), 25).otherwise(0)


def best_first_registrations(events: DataFrame, ties: Sequence[Column | str]) -> DataFrame:
    """(vehicle_id, value, source, score, occurred_at): each vehicle's most precise first registration; the earliest of equals."""
    m = F.col("_m")
    some = events.withColumn("_m", meta.parsed(F.col("metadata"))).filter(is_first_registration(F.col("event_type"), F.col("description"), m))
    some = some.withColumns({"value": meta.text(m, "value"), "source": meta.text(m, "source")})
    some = some.withColumn("score", first_registration_score(F.col("value"), F.col("source")))
    best = richest_per_key(some, ["vehicle_id"], F.col("score"), [F.col("occurred_at").asc_nulls_last(), *ties])
    return best.select("vehicle_id", "value", "source", "score", "occurred_at")


def archived(pages: DataFrame, known: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Payloads to archive (K8, F18): not null, no web pages, cut at MOST_RAW characters, and new by provider, source id and content. Needs provider_id, source_id, raw."""
    some = pages.filter(F.col("raw").isNotNull() & ~looks_like_page(F.col("raw"))).withColumn("raw", F.substring("raw", 1, MOST_RAW))
    some = some.withColumn("content_hash", F.sha2(F.col("raw").cast("binary"), 256))
    keys = ["provider_id", "source_id", "content_hash"]
    return first_per_key(some, keys, order).join(known.select(*keys).distinct(), keys, "left_anti")


def unchanged(known: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints of a discovery that need no fetch (E29): the listing is complete (a vin of 17, a usable reading), price and mileage are as hinted, and the hinted change
    is at most two seconds after it was last seen. Both have provider_id and source_id; hints have price, mileage and modified_at."""
    both = hints.join(known.select("provider_id", "source_id", "vin", F.col("price_amount").alias("_p"), F.col("mileage").alias("_m"), "last_seen_at"), ["provider_id", "source_id"])
    return both.filter(
        (F.length("vin") == 17) & M.usable(F.col("_m")) & F.col("price").eqNullSafe(F.col("_p")) & F.col("mileage").eqNullSafe(F.col("_m"))
        & (F.col("modified_at").isNull() | (F.col("modified_at") <= F.col("last_seen_at") + F.expr("INTERVAL 2 SECONDS")))
    ).select(*hints.columns)


def recently_seen(known: DataFrame, hints: DataFrame, as_of: str, hours: int, photos: int = 2) -> DataFrame:
    """Hints of listings that were seen within so many hours, are complete and have enough photos (E29): they need no fetch. known: provider_id, source_id, vin, mileage,
    last_seen_at, n_photos."""
    now = F.lit(as_of).cast("timestamp_ntz")
    done = known.filter(M.usable(F.col("mileage")) & (F.col("n_photos") >= photos) & (F.col("last_seen_at") > now - F.expr(f"INTERVAL {int(hours)} HOURS")))
    # Where the vin is computed from a key, Spark would infer a filter on it for all that is joined by that key, and compute it for each of those rows.
    done = kept(done, F.length("vin") == 17).select("provider_id", "source_id").distinct()
    return hints.join(done, ["provider_id", "source_id"], "left_semi")
