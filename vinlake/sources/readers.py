"""Readers: listing imports from JSON and CSV, web pages, batches by key, samples and literal rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.functions.numbers import tidy
from vinlake.functions.text import looks_like_page
from vinlake.operators.windows import first_per_key

LISTING = "vin string, provider string, source_id string, make string, model string, year int, price double, currency string, mileage double, active string"
#: One file may hold {"listings": [...]}, {"vehicles": [{..., "listings": [...]}]}, or bare listings.
FILE = f"{LISTING}, listings array<struct<{LISTING.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>, vehicles array<struct<{LISTING.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')},listings:array<struct<{LISTING.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>>>"
NAMES = [x.split()[0] for x in LISTING.split(", ")]


def read_listings_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Listings of JSON files in any of the shapes of FILE, as a flat table (S11); lines: each line is such an object, so that large files can be split. A vehicle's fields
    fill those that its listings lack. Rows without a vin or provider are dropped; without a source id they get import:<vin>."""
    files = spark.read.schema(FILE).json(path, multiLine=not lines)
    bare = files.filter("listings IS NULL AND vehicles IS NULL").select(*NAMES)
    direct = files.select(F.inline("listings"))
    cars = files.select(F.explode("vehicles").alias("v"))
    nested = cars.select("v", F.explode("v.listings").alias("l")).select(*(F.coalesce(f"l.{n}", f"v.{n}").alias(n) for n in NAMES))
    return _imported(bare.unionByName(direct).unionByName(nested))


def read_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Listings of CSV files with a header, in any order of columns (S12): quotes doubled within quotes, a byte-order mark allowed, lacking columns null."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    raw = raw.toDF(*(c.lstrip("﻿").strip().strip('"').lower() for c in raw.columns))
    kinds = dict(x.split() for x in LISTING.split(", "))
    return _imported(raw.select(*((F.col(n) if n in raw.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in NAMES)))


def _imported(df: DataFrame) -> DataFrame:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = df.withColumns({"vin": F.upper(filled("vin")), "provider": filled("provider"), "source_id": filled("source_id"), "active": F.coalesce(F.lower(F.trim("active")) != "no", F.lit(True))})
    return rows.filter("vin IS NOT NULL AND provider IS NOT NULL").withColumn("source_id", F.coalesce("source_id", F.concat(F.lit("import:"), "vin")))


def page_fields(html: Column) -> dict[str, Column]:
    """What pages say in their markup (S14): title, language, heading, links, paragraphs, pictures, embedded JSON and the last page of a pager."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    pager = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)[?&]page=(\d{1,6})"), 1), lambda x: x.cast("int"))
    return {
        "title": F.nullif(tidy(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")),
        "lang": F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']([^"']*)["']""", 1), F.lit("")),
        "heading": F.nullif(tidy(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")), F.lit("")),
        "n_links": F.size(links).cast("long"),
        "n_paragraphs": F.coalesce(F.regexp_count(html, F.lit(r"(?i)<p[\s>]")), F.lit(0)).cast("long"),
        "data": F.nullif(F.regexp_extract(html, r"""(?is)<script[^>]*type\s*=\s*["']application/(?:ld\+)?json["'][^>]*>(.*?)</script>""", 1), F.lit("")),
        "last_page": F.array_max(pager),
        "is_page": looks_like_page(html),
    }


def spec_table(df: DataFrame, html: str, *keep: str) -> DataFrame:
    """(keep..., pos, name, value): the two-column rows of a page's tables and definition lists."""
    row = r"(?is)<(?:tr|dt)[^>]*>\s*(?:<t[hd][^>]*>)?(.*?)</(?:t[hd]|dt)>\s*<(?:td|dd)[^>]*>(.*?)</(?:td|dd)>"
    names, values = (F.regexp_extract_all(html, F.lit(row), i) for i in (1, 2))
    plain = lambda c: tidy(F.regexp_replace(c, "<[^>]*>", " "))
    rows = df.select(*keep, F.posexplode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("pos", "x"))
    return rows.select(*keep, "pos", plain(F.col("x.n")).alias("name"), plain(F.col("x.v")).alias("value")).filter("name != ''")


def batch_after(df: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """The next `size` rows after a key (S6): a filter that Parquet can skip by, and a bounded top-n."""
    return df.filter(F.col(key) > cursor).orderBy(key).limit(size)


def in_sample(key: str, per_thousand: int) -> Column:
    """Whether a key's hash falls into a share (S7): the same rows on every run. As a condition it can stand in aggregates beside those of all rows."""
    return F.pmod(F.xxhash64(key), F.lit(1000)) < per_thousand


def sampled(df: DataFrame, key: str, per_thousand: int) -> DataFrame:
    """The rows in the sample."""
    return df.filter(in_sample(key, per_thousand))


def scaled_up(sample_count: Column, total: Column, sample_total: Column) -> Column:
    """A count estimated from a sample (A18): at most the total; under 50 sampled rows, 65 percent of the total."""
    return F.when(sample_total >= 50, F.least(total, F.floor(sample_count * total / sample_total + 0.5).cast("long"))).otherwise(F.floor(total * 0.65 + 0.5).cast("long"))


def id_windows(df: DataFrame, key: str, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows whose key falls into one of some ranges."""
    cond = F.lit(False)
    for low, high in windows:
        cond = cond | F.col(key).between(low, high)
    return df.filter(cond)


def literal_rows(spark: SparkSession, json: str, schema: str) -> DataFrame:
    """Rows of a JSON array literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json), f"array<struct<{schema}>>")))


def has_column(spark: SparkSession, table: str, column: str) -> bool:
    """Whether a table has a column."""
    return any(c.name == column for c in spark.catalog.listColumns(table))


def newest_refs(refs: DataFrame) -> DataFrame:
    """Discovered references, each source id once."""
    return first_per_key(refs, ["source_id"], ["page", "pos"])


#: Parsers by adapter name (S1, S2): each turns raw pages (url, html) into rows.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str):
    """Registers a parser of raw pages under a name."""

    def put(f: Callable[[DataFrame], DataFrame]):
        ADAPTERS[name] = f
        return f

    return put


@adapter("generic")
def generic_pages(pages: DataFrame) -> DataFrame:
    """(url, title, lang, heading, n_links, n_paragraphs, data, last_page, is_page)"""
    return pages.select("url", *(c.alias(n) for n, c in page_fields(F.col("html")).items()))


@adapter("specs")
def spec_pages(pages: DataFrame) -> DataFrame:
    """(url, pos, name, value)"""
    return spec_table(pages, "html", "url")
