"""Galleries: picture identity, set hashes, the canonical listing, caps and overflow."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinlake.functions import urls
from vinlake.functions.once import bound

# Fixed values.
MOST_GALLERY, MOST_FRAMES, OVERFLOW = 40, 72, 10_000


def identified(photos: DataFrame, keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Photos that are no junk, with the key that sizes of one picture share (E12, E15); keys: rules of hosts that name their pictures."""
    return photos.filter(~urls.junk_picture(F.col("source_url"))).withColumn("picture", urls.picture_by_rules(F.col("source_url"), keys))


def set_hashes(photos: DataFrame, key: str) -> DataFrame:
    """(key, pictures, set_hash): the first 32 hex digits of the SHA-256 of a listing's different pictures in order."""
    one = identified(photos).groupBy(key).agg(F.array_sort(F.collect_set("picture")).alias("p"))
    return one.select(key, F.size("p").cast("long").alias("pictures"), F.substring(F.sha2(F.array_join("p", "|").cast("binary"), 256), 1, 32).alias("set_hash"))


def canonical_listings(photos: DataFrame, listings: DataFrame | None = None, hosts: Sequence[tuple[str, int]] = (), preferred: DataFrame | None = None) -> DataFrame:
    """(vehicle_id, canonical): the listing whose gallery leads (E14): ten points a picture, 100 if it is active, 120 for a numeric source id, minus 350 for a mirror
    (lot/..., listing/...) and 500 for a catalog (catalog:...), the points of each of `hosts` (pattern, points) that one of its addresses fits, and 400 if it is
    preferred; of equals the smaller id. listings: (listing_id, source_id, is_active). preferred: (vehicle_id, preferred): it counts for nothing if it is a mirror or
    catalog and the vehicle has another listing that is neither, or if its hosts' points are below zero and another listing has over 50 more."""
    fits = [F.bool_or(F.coalesce(F.col("source_url").rlike(p), F.lit(False))) for p, _ in hosts]
    points = sum((F.when(f, n).otherwise(0) for f, (_, n) in zip(fits, hosts)), F.lit(0))
    rows = photos.filter("listing_id IS NOT NULL").groupBy("vehicle_id", "listing_id").agg(F.count(F.lit(1)).alias("n"), points.alias("host"))
    rows = rows.join(listings.select("listing_id", "source_id", "is_active"), "listing_id", "left") if listings is not None else rows.withColumns({"source_id": F.lit(None).cast("string"), "is_active": F.lit(False)})
    sid = F.coalesce("source_id", F.lit(""))
    rows = rows.withColumns({"catalog": sid.rlike("(?i)^catalog:"), "mirror": sid.rlike(r"(?i)^(?:lot|listing)/")})
    score = 10 * F.col("n") + F.col("host") + F.when(F.col("is_active"), 100).otherwise(0) + F.when(sid.rlike(r"^\d{5,}$"), 120).otherwise(0) - F.when(F.col("mirror"), 350).otherwise(0) - F.when(F.col("catalog"), 500).otherwise(0)
    if preferred is not None:
        w = Window.partitionBy("vehicle_id")
        mine, foreign = F.col("listing_id") == F.col("preferred"), F.col("mirror") | F.col("catalog")
        rows = rows.join(preferred, "vehicle_id", "left").withColumns({"others": F.max(F.when(~foreign & ~F.coalesce(mine, F.lit(False)), 1)).over(w), "best": F.max("host").over(w)})
        score = score + F.when(mine & ~(foreign & F.col("others").isNotNull()) & ~((F.col("host") < 0) & (F.col("best") > F.col("host") + 50)), 400).otherwise(0)
    return rows.groupBy("vehicle_id").agg(F.min_by("listing_id", F.struct(-score, "listing_id")).alias("canonical"))


def galleries(photos: DataFrame, canonical: DataFrame, most: int = MOST_GALLERY, frames: int = MOST_FRAMES) -> DataFrame:
    """(vehicle_id, listing_id, picture, photo_group, sort_order, is_primary, shown) of each different picture.

    A vehicle's gallery is its canonical listing's block and then other listings' blocks, at most `most` pictures; those beyond it stay, not shown, with sort_order
    from OVERFLOW on. Exterior frames, at most `frames`, are shown only where a still is. A picture that several rows hold counts once, at its first place."""
    lead = F.when(F.col("listing_id") == F.col("canonical"), 0).otherwise(1)
    order = [lead, F.col("listing_id").asc_nulls_last(), F.col("is_primary").desc(), "sort_order", "source_url"]
    rows = identified(photos).join(canonical, "vehicle_id", "left").withColumn("_first", F.row_number().over(Window.partitionBy("vehicle_id", "photo_group", "picture").orderBy(*order)))
    rows = rows.filter("_first = 1")
    n = F.row_number().over(Window.partitionBy("vehicle_id", "photo_group").orderBy(*order))
    stills = F.sum(F.when(F.col("photo_group") == "gallery", 1).otherwise(0)).over(Window.partitionBy("vehicle_id"))
    limit = F.when(F.col("photo_group") == "gallery", most).otherwise(frames)
    rows = rows.withColumns({"_n": n, "_stills": stills}).withColumn("shown", (F.col("_n") <= limit) & ((F.col("photo_group") == "gallery") | (F.col("_stills") > 0)))
    return rows.select(
        "vehicle_id", "listing_id", "picture", "photo_group", F.when(F.col("_n") <= limit, F.col("_n") - 1).otherwise(OVERFLOW + F.col("_n") - limit).cast("int").alias("sort_order"),
        ((F.col("_n") == 1) & (F.col("photo_group") == "gallery")).alias("is_primary"), "shown",
    )


def split_by_host(photos: DataFrame, cdn: str, keys: Sequence[tuple[str, str]] = (), frames: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """(vehicle_id, bucket, picture, place): mirrored pictures (hosts that end in `cdn`) and those at their source, each picture once a bucket, in frame order (E16, O8);
    keys, frames: rules of hosts that name and count their pictures."""
    rows = identified(photos, keys).withColumns({"bucket": F.when(F.endswith(urls.host(F.col("source_url")), F.lit(cdn)), "mirrored").otherwise("source"), "frame": urls.frame_by_rules(F.col("source_url"), frames)})
    one = rows.groupBy("vehicle_id", "bucket", "picture").agg(F.min("frame").alias("frame"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("vehicle_id", "bucket").orderBy(F.col("frame").asc_nulls_last(), "picture"))).drop("frame")


def of_own_lot(photos: DataFrame, lot: str, pattern: str = r"/lots?/(\d+)(?:/|$)") -> DataFrame:
    """Photos whose address names no lot, or the lot in column `lot` (E15): foreign lots' pictures get onto pages as recommendations. A null lot keeps all."""
    named = F.nullif(F.regexp_extract(urls.plain(F.col("source_url")), pattern, 1), F.lit(""))
    return photos.filter(F.col(lot).isNull() | bound(named, lambda n: n.isNull() | (n == F.col(lot).cast("string"))))


def without_orphan_frames(photos: DataFrame) -> DataFrame:
    """Photos without exterior and interior frames of listings that have no still (E15, J18): frames alone can't be shown."""
    # A window over each listing's photos takes one pass; stills joined to frames would compute the photos for each branch.
    still = F.col("photo_group") == "gallery"
    rows = photos.withColumn("_stills", F.bool_or(still).over(Window.partitionBy("vehicle_id", "listing_id")))
    named = F.col("vehicle_id").isNotNull() & F.col("listing_id").isNotNull()
    return rows.filter(still | (F.col("photo_group").isNotNull() & F.col("_stills") & named)).drop("_stills")


#: Where an address states the stock number of a lot: in a file's name before the frame, in a folder below a year, in the query.
STOCKS = (r"(?i)/(\d{6,})-\d{0,3}[a-z]?\.(?:jpe?g|webp|png)(?:\?|$)", r"(?i)[?&]partitionKey=(\d{6,})(?:&|#|$)", r"(?i)[?&]imageKeys?=(\d{6,})(?:~|%7E)", r"/\d{4}/(\d{6,})/")


def stock_number(url: Column, patterns: Sequence[str] = STOCKS) -> Column:
    """The stock number that a picture's address states, by the first pattern that finds one; null where none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns))


def of_listing_stock(photos: DataFrame, listings: DataFrame, patterns: Sequence[str] = STOCKS, exempt: str | None = None) -> DataFrame:
    """Photos whose address states no stock number, or one that is in their listing's source id (E15): thumbnails of similar lots get onto pages. listings: (listing_id,
    source_id). A photo without a listing, of a listing without a number of six digits, or whose address fits `exempt` stays; empty addresses and blank pixels go."""
    pins = F.regexp_extract_all(F.regexp_replace("source_id", "(?i)^im-", ""), F.lit(r"(\d{6,})"), 1)
    rows = photos.join(listings.select(F.col("listing_id").alias("_l"), pins.alias("_pins")), F.col("listing_id") == F.col("_l"), "left")
    stock = stock_number(F.col("source_url"), patterns)
    free = F.col("source_url").rlike(exempt) if exempt else F.lit(False)
    fits = stock.isNull() | F.coalesce(F.size("_pins") == 0, F.lit(True)) | F.coalesce(F.array_contains("_pins", stock), F.lit(False)) | free
    there = (F.coalesce(F.trim("source_url"), F.lit("")) != "") & ~F.col("source_url").rlike(r"(?i)^data:image/gif|1x1|pixel\.gif|spacer\.gif")
    return rows.filter(there & fits).select(*photos.columns)


@dataclass(frozen=True)
class Market:
    """A market: the providers whose listings belong to it, the addresses of its pictures, and those that tell the market of a listing of another provider."""

    origins: tuple[str, ...]
    pictures: str
    telling: str


def of_own_market(photos: DataFrame, listings: DataFrame, one: Market, two: Market) -> DataFrame:
    """Photos without those of the other market (E15): cards of related cars mix both. listings: (listing_id, origin). A listing's market is its provider's, else the first
    whose pictures it shows (`one` if both), else none, and then all stay; so do photos without a listing.

    What a listing shows is summed up by listing first, so a page with many pictures is no load."""
    tells = lambda m: F.bool_or(F.coalesce(F.col("source_url").rlike(m.telling), F.lit(False)))
    shows = photos.filter("listing_id IS NOT NULL").groupBy(F.col("listing_id").alias("_l")).agg(tells(one).alias("_one"), tells(two).alias("_two"))
    shows = shows.join(listings.select(F.col("listing_id").alias("_l"), F.lower("origin").alias("_origin")), "_l", "left")
    market = F.when(F.col("_origin").isin(*one.origins), 1).when(F.col("_origin").isin(*two.origins), 2).when(F.col("_one"), 1).when(F.col("_two"), 2)
    rows = photos.join(shows.select("_l", market.alias("_market")), F.col("listing_id") == F.col("_l"), "left")
    foreign = F.when(F.col("_market") == 1, F.col("source_url").rlike(two.pictures)).when(F.col("_market") == 2, F.col("source_url").rlike(one.pictures))
    return rows.filter(~F.coalesce(foreign, F.lit(False))).select(*photos.columns)


def of_verified_pages(photos: DataFrame, listings: DataFrame, pictures: str, aggregators: str) -> DataFrame:
    """Photos without those that fit `pictures` on a listing whose own address fits `aggregators` (E15): an aggregator's page can't vouch for an auction's frames.
    listings: (listing_id, listing_url); photos without a listing stay."""
    rows = photos.join(listings.select(F.col("listing_id").alias("_l"), "listing_url"), F.col("listing_id") == F.col("_l"), "left")
    return rows.filter(~F.coalesce(F.col("source_url").rlike(pictures) & F.col("listing_url").rlike(aggregators), F.lit(False))).select(*photos.columns)
