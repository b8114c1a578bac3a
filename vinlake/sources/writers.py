"""Writers: CSV and nested JSON exports, snapshots and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.functions import mileage as M
from vinlake.functions.money import with_usd_eur
from vinlake.operators.joins import broadcast_if_small
from vinlake.session import scratch

# The columns of a CSV export, in order.
CSV_COLUMNS = (
    "vin", "make", "model", "year", "trim", "fuel", "transmission", "drivetrain", "engine", "color", "body_type", "mileage_km", "mileage_miles", "price", "currency", "price_usd", "price_eur", "location",
    "country", "active", "source_id", "listing_url", "provider", "first_seen", "last_seen",
)

#: Providers up to this many are broadcast: ids and short names, some 50 MB.
MOST_PROVIDERS = 500_000


def export_rows(listings: DataFrame, vehicles: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows of a CSV export (K6): dollars, euros and miles are derived; a missing column is null. Providers are a small dimension, so the wide rows are not shuffled for them."""
    names = broadcast_if_small(providers.select(F.col("id").alias("provider_id"), F.col("internal_name").alias("provider")), MOST_PROVIDERS)
    rows = listings.join(vehicles.withColumnRenamed("id", "vehicle_id"), "vehicle_id").join(names, "provider_id")
    rows = with_usd_eur(rows, "price_amount", "price_currency", "price_usd", "price_eur")
    km = M.to_km(F.when(M.usable(F.col("mileage")), F.col("mileage")), F.col("mileage_unit"))
    rows = rows.withColumns({"mileage_km": km, "mileage_miles": M.to_miles(km), "price": F.col("price_amount"), "currency": F.col("price_currency"), "fuel": F.col("fuel_type")})
    rows = rows.withColumns({"active": F.when(F.lower(F.trim("listing_status")) == "active", "yes").otherwise("no"), "first_seen": F.date_format("first_seen_at", "yyyy-MM-dd"), "last_seen": F.date_format("last_seen_at", "yyyy-MM-dd")})
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS))


#: The mark by which spreadsheets know UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header each, which begins with the byte order mark; quotes only where they are needed, doubled within."""
    first = df.columns[0]
    df.withColumnRenamed(first, BYTE_ORDER_MARK + first).write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode="overwrite")


def nested(listings: DataFrame, children: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Listings with an array of structs of each kind of child (K7), in the order of their fields: children are summed up by key before the join."""
    out = listings
    for name, df in children.items():
        fields = [c for c in df.columns if c not in keys]
        out = out.join(df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), keys, "left")
    return out


def in_envelope(df: DataFrame, kind: str, version: int, at: str, name: str = "listing") -> DataFrame:
    """Rows in an export's envelope (K7): format, version, exportedAt and the row as a struct under `name`."""
    return df.select(F.lit(kind).alias("format"), F.lit(version).alias("version"), F.lit(at).alias("exportedAt"), F.struct(*(F.col(c) for c in df.columns)).alias(name))


def write_json(df: DataFrame, path: str, kind: str | None = None, version: int = 1, at: str | None = None) -> None:
    """A JSON object a line; with `kind` each in its envelope, so that every part can be read by itself."""
    (in_envelope(df, kind, version, at) if kind else df).write.json(path, mode="overwrite")


def append(df: DataFrame, path: str, *by: str) -> None:
    """Appends to a Parquet folder, in folders by column."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: what several branches of a query need isn't computed for each."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def snapshot(df: DataFrame, base: str, version: int) -> str:
    """Writes a new version of a table beside the last one and returns its path: readers of the old version aren't disturbed (K2, K3)."""
    path = f"{base.rstrip('/')}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path
