"""A target that a stream changes: rows are merged by key into buckets, each bucket in versions by batch number.

    <path>/bucket=<hash of the key>/batch=<number>/...   the whole bucket after that batch
    <path>/_done/<number>                                 the batch is complete

A batch reads the buckets that its rows touch, each at its newest version before this batch, merges, and writes them anew under its own number; other buckets stay as they
are. So a batch that is run again after a failure starts from the same versions and writes the same rows over its first try, and a reader, who takes versions up to the
last complete batch, sees all of a batch or nothing. Merges must be idempotent and free of order (minima, maxima, least structs): then late, repeated and shuffled rows
give what one merge of all rows gives. A bucket keeps two versions, the one of the last complete batch that touched it and the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vinlake.functions import dates

Merge = Callable[[DataFrame], DataFrame]
#: Buckets of a target: more of them spare more rewriting where batches are small.
BUCKETS = 64
#: Rows that a task writes of a bucket, or thereabouts.
PIECE = 500_000


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last complete batch, -1 before the first."""
    return max(map(int, _names(spark, f"{path}/_done")), default=-1)


def versions(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> dict[int, list[int]]:
    """The versions of each bucket (or of those named), in order: a listing of folders, no data is read."""
    named = buckets if buckets is not None else [int(n.partition("=")[2]) for n in _names(spark, path) if n.startswith("bucket=")]
    return {b: sorted(int(n.partition("=")[2]) for n in _names(spark, f"{path}/bucket={b}") if n.startswith("batch=")) for b in named}


def _read(spark: SparkSession, path: str, schema: StructType, chosen: dict[int, int]) -> DataFrame:
    parts = [f"{path}/bucket={b}/batch={v}" for b, v in sorted(chosen.items())]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The target's rows after the last complete batch; with `wanted` (rows of the keys) only the buckets that these can be in are opened."""
    last = last_batch(spark, path)
    some = None if wanted is None else _touched(with_bucket(wanted, keys, bucket_count(spark, path)))
    found = {b: [v for v in vs if v <= last] for b, vs in versions(spark, path, some).items()}
    return _read(spark, path, schema, {b: vs[-1] for b, vs in found.items() if vs})


def bucket_count(spark: SparkSession, path: str) -> int:
    """How many buckets the target was made with."""
    named = _names(spark, f"{path}/_buckets")
    if not named:
        raise ValueError(f"{path} is no target of merge_batch")
    return int(named[0])


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def dealt(df: DataFrame, rows: int, keys: Sequence[str], buckets: int) -> DataFrame:
    """df (with bucket) dealt out for writing: a bucket is one piece while it is small, and more as its rows grow, so that no task has to write a bucket of any size."""
    pieces = -(-rows // (buckets * PIECE)) or 1
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * buckets * pieces)
    return df.repartition(tasks, "bucket", F.pmod(F.hash(*keys), F.lit(pieces)))


def _touched(df: DataFrame) -> list[int]:
    return sorted(r.bucket for r in df.select("bucket").distinct().collect())  # as many as there are buckets


def merge_batch(batch: DataFrame, number: int, path: str, keys: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> None:
    """Merges a batch (rows as `merge` takes and gives them) into the target at `path`, as the batch of this number."""
    spark, path = batch.sparkSession, path.rstrip("/")
    fs, made = _folder(spark, f"{path}/_buckets/{buckets}")
    if _names(spark, f"{path}/_buckets") not in ([], [str(buckets)]):
        raise ValueError(f"{path} has {bucket_count(spark, path)} buckets, not {buckets}")
    fs.create(made, True).close()
    # Rows of a batch are summed up by key first, so a key that many of them share is one row of its bucket.
    fresh = with_bucket(merge(batch), keys, buckets).persist()
    try:
        touched = _touched(fresh)
        before = {b: [v for v in vs if v < number] for b, vs in versions(spark, path, touched).items()}
        old = with_bucket(_read(spark, path, batch.schema, {b: vs[-1] for b, vs in before.items() if vs}), keys, buckets)
        new = with_bucket(merge(old.unionByName(fresh).drop("bucket")), keys, buckets).withColumn("batch", F.lit(number))
        dealt(new, old.count() + fresh.count(), keys, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    finally:
        fresh.unpersist()
    fs.create(_folder(spark, f"{path}/_done/{number}")[1], True).close()
    for b, vs in before.items():  # readers of the version before this one aren't disturbed
        for v in vs[:-1]:
            fs.delete(_folder(spark, f"{path}/bucket={b}/batch={v}")[1], True)


def merge_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges a stream into the target, batch by batch, until all that is there is taken."""
    return rows.writeStream.foreachBatch(lambda b, n: merge_batch(b, n, path, keys, merge, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- observations as such a target


def observation_states(observations: DataFrame, keys: Sequence[str], as_of: str, carry: Sequence[str] = ()) -> DataFrame:
    """The state that each observation is by itself: keys, listed_at and updated_at (null if unbelievable), seen_at, and what the first observation of a key carries."""
    now = F.lit(as_of).cast("timestamp_ntz")
    plain = lambda c: F.col(c).cast("timestamp_ntz")  # noqa: E731  a stream's event times have a zone
    ok = lambda c: F.when(dates.reasonable(plain(c), now), plain(c)).alias(c)
    first = F.struct(plain("observed_at").alias("seen_at"), *carry).alias("first")
    return observations.select(*keys, ok("listed_at"), ok("updated_at"), first)


def merged_states(keys: Sequence[str]) -> Merge:
    """One state for each key: the earliest listing, the latest change, the least first observation. Free of order and idempotent."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("listed_at").alias("listed_at"), F.max("updated_at").alias("updated_at"), F.min("first").alias("first"))

    return merge


def observations_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations from their states (T6): observed_at moves back to the listing's (else the change's) date only if that is over a day earlier."""
    preferred, seen = F.coalesce("listed_at", "updated_at"), F.col("first.seen_at")
    at = F.when(preferred + F.expr("INTERVAL 24 HOURS") < seen, preferred).otherwise(seen)
    return states.select(*keys, "listed_at", "updated_at", at.alias("observed_at"), *(F.col(f"first.{c}").alias(c) for c in states.schema["first"].dataType.names if c != "seen_at"))
