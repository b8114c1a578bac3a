"""What the public may see of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.functions import meta

# Fields that tell where a row is from.
INTERNAL = {
    "listing": ("provider_id", "source_id", "source_url", "fx"), "observation": ("provider_id", "fx"), "owner": ("source",), "accident": ("source",), "sale": ("provider", "source", "source_listing_id"), "mileage": ("source", "sources"),
    "photo": ("source_url",),
}
INTERNAL_META = ("source", "provider", "providerId", "sourceId", "sourceUrl", "sourceListingId")


def public(df: DataFrame, kind: str) -> DataFrame:
    """df without internal columns of its kind (F15); columns that it lacks don't matter."""
    return df.drop(*INTERNAL[kind])


def public_events(df: DataFrame) -> DataFrame:
    """Events without internal metadata; null where nothing else was in it."""
    return df.withColumn("metadata", F.nullif(meta.without(F.col("metadata"), *INTERNAL_META), F.lit("{}")))


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of a condition on costly columns. A filter would be pushed below those columns, into the join under them, and compute them twice; a generator's rows are not."""
    rows = df.withColumn("_kept", condition)
    return rows.select("*", F.explode(F.when(F.col("_kept"), F.array(F.lit(True)))).alias("_one")).drop("_kept", "_one")
