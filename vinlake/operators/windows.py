"""Window operators: first row per key, runs, gap-filled series, caps and ranked choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the order."""
    return cap_per_key(df, keys, order, 1)


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """The first `most` rows of each key (W5, W9). Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def richest_per_key(df: DataFrame, keys: Sequence[str], score: Column, ties: Sequence[Column | str]) -> DataFrame:
    """The row of the highest score of each key (A22); ties by the order given."""
    return first_per_key(df.withColumn("_score", score), keys, [F.col("_score").desc(), *ties]).drop("_score")


def merged_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], fields: Sequence[str]) -> DataFrame:
    """One row per key; each field is its first value that is not null, in the order."""
    w = Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = df.select(*keys, *(F.first(f, ignorenulls=True).over(w).alias(f) for f in fields), F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order))).alias("_n"))
    return found.filter("_n = 1").drop("_n")


def majority(df: DataFrame, key: str, value: str, first_seen: Column) -> DataFrame:
    """(key, value, n): each key's most frequent value; ties go to the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(first_seen).alias("_first"))
    return first_per_key(counts, [key], [F.col("n").desc(), "_first", value]).drop("_first")


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], same: Column, name: str = "run") -> DataFrame:
    """df with the number of each row's run: a new one begins where `same` (which may use F.lag over run_window) is not true."""
    w = run_window(keys, order)
    return df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def run_window(keys: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*keys).orderBy(*_order(order))


def buckets(since: str, until: str, unit: str) -> Column:
    """All UTC hours or days from since to until, both included, as an array."""
    start, end = (F.date_trunc(unit, F.lit(x).cast("timestamp_ntz")).cast("timestamp_ntz") for x in (since, until))
    return F.sequence(start, end, F.expr(f"INTERVAL 1 {unit.upper()}"))


def gap_filled(spark, series: DataFrame, bucket: str, since: str, until: str, unit: str) -> DataFrame:
    """The series with a row of zeros for each bucket that it lacks (W8). The calendar is bounded by the range, and so is small."""
    calendar = spark.range(1).select(F.explode(buckets(since, until, unit)).alias(bucket))
    return calendar.join(series, bucket, "left").na.fill(0)


def round_robin(df: DataFrame, owner: str, group: str, order: Sequence[Column | str], most: int) -> DataFrame:
    """At most `most` rows per owner, one of each group in turn (W1): first by place within (owner, group), then by that place. Adds `place`, from 1."""
    inner = df.withColumn("_rn", F.row_number().over(Window.partitionBy(owner, group).orderBy(*_order(order))))
    outer = Window.partitionBy(owner).orderBy("_rn", F.col(group).asc_nulls_last(), *_order(order))
    return inner.withColumn("place", F.row_number().over(outer)).filter(F.col("place") <= most).drop("_rn")


def resequenced(df: DataFrame, owner: str, order: Sequence[Column | str]) -> DataFrame:
    """sort_order from 0 and is_primary for the first row, by owner."""
    n = F.row_number().over(Window.partitionBy(owner).orderBy(*_order(order)))
    return df.withColumn("_n", n).withColumns({"sort_order": F.col("_n") - 1, "is_primary": F.col("_n") == 1}).drop("_n")
