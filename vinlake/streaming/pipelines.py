"""Structured Streaming: usage windows, once-only observations, rate limits, sessions and ledgers.

Sources are files of new rows; triggers take all that is there and stop (availableNow), so a run ends and its results can be compared with a batch. State is bounded by
watermarks, or by the number of keys where a limit has to remember them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from vinlake.operators.ingest import CONTENT, status_key
from vinlake.streaming import merging


def stream(spark: SparkSession, path: str, schema: StructType, ts: str, late: str, files: int | None = 8) -> DataFrame:
    """Rows of Parquet files as they come, some files a batch (None: all that are there), with a watermark. Event times must be timestamps with a zone, so plain ones are
    read as UTC."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_usage(logs: DataFrame, length: str = "1 day") -> DataFrame:
    """(bucket, total, ok, errors) of each window (T1, T13); a window ends when the watermark passes it."""
    out = logs.groupBy(F.window("requested_at", length)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status_code").between(200, 299)).alias("ok"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    return out.select(F.col("window.start").alias("bucket"), "total", "ok", "errors")


def sliding_usage(logs: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """(bucket, total) of trailing windows."""
    return logs.groupBy(F.window("requested_at", length, step)).agg(F.count(F.lit(1)).alias("total")).select(F.col("window.start").alias("bucket"), "total")


def client_sessions(logs: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(client_id, began, n) of sessions."""
    return logs.groupBy("client_id", F.session_window("requested_at", gap)).agg(F.min("requested_at").alias("began"), F.count(F.lit(1)).alias("n")).drop("session_window")


def once_only(observations: DataFrame) -> DataFrame:
    """Observations of new content within the watermark's reach (T5, E2); what comes later than that, the sink's anti-join drops."""
    return observations.withColumn("status_key", status_key(F.col("listing_status"))).dropDuplicatesWithinWatermark(list(CONTENT))


def append_new(observations: DataFrame, path: str, checkpoint: str, buckets: int = merging.BUCKETS) -> StreamingQuery:
    """Appends observations (with status_key) that a history folder lacks (T5, K1), in folders by the hash of their content. A batch reads of the history only the folders that
    its rows can be in, and there only what earlier batches wrote; run again after a failure it writes the same folders again, so nothing is doubled. Contents that a batch
    repeats count once, so a stream needs no once_only before it: that spares small batches rows, at the price of state for each content within the watermark."""
    root = path.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = merging.with_bucket(batch.dropDuplicates(list(CONTENT)), CONTENT, buckets).persist()
        try:
            counts = {r.bucket: r["n"] for r in fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as there are buckets
            parts = [f"{root}/bucket={b}/batch={v}" for b, vs in merging.versions(spark, root, sorted(counts)).items() for v in vs if v < number]
            new = fresh
            if parts:
                old = spark.read.schema(batch.schema).parquet(*parts).select(*(F.col(c).alias(f"_{c}") for c in CONTENT))
                new = fresh.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CONTENT], "left_anti")
            new = merging.dealt(new.withColumn("batch", F.lit(number)), sum(counts.values()), CONTENT, buckets)
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(root)
        finally:
            fresh.unpersist()

    return observations.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VERDICTS = "client_id long, id long, requested_at timestamp, allowed boolean, used long"


class DailyLimit(StatefulProcessor):
    """State of a client: the day and the successes so far on it. Requests of a batch are taken in order of time; those of an earlier day than the state's count
    for no one."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("day", "day string, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["requested_at", "id"])  # one client's requests of one batch
        day, used = self.state.get() if self.state.exists() else ("", 0)
        allowed, counts = [], []
        for at, status in zip(frame["requested_at"], frame["status_code"]):
            today = at.strftime("%Y-%m-%d")
            if today > day:
                day, used = today, 0
            allowed.append(used < self.limit)
            counts.append(used)
            used += int(200 <= status < 300 and today == day)
        self.state.update((day, used))
        yield pd.DataFrame({"client_id": key[0], "id": frame["id"], "requested_at": frame["requested_at"], "allowed": allowed, "used": counts})

    def close(self) -> None:
        pass


def daily_limits(logs: DataFrame, limit: int) -> DataFrame:
    """(client_id, id, requested_at, allowed, used): what a daily limit says to each request (T3). The state store must be RocksDB."""
    return logs.groupBy("client_id").transformWithStateInPandas(statefulProcessor=DailyLimit(limit), outputStructType=VERDICTS, outputMode="Append", timeMode="None")


THROTTLED = "client_id long, id long, n long, allowed boolean"


class Throttle(StatefulProcessor):
    """State of a client: the times of its events of the last `seconds`, in order. A timer at the last one's end clears them once the watermark has passed it, so clients
    that are gone leave nothing. Rows of a batch are taken in order of time; those of one moment count one another, as a window by range does."""

    def __init__(self, seconds: int, most: int):
        self.span, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["requested_at", "id"])  # one client's requests of one batch
        new = frame["requested_at"].to_numpy().astype("datetime64[us]").astype("int64")
        held = np.array([x[0] for x in self.times.get()], dtype="int64") if self.times.exists() else np.zeros(0, "int64")
        both = np.sort(np.concatenate([held, new]))
        n = np.searchsorted(both, new, side="right") - np.searchsorted(both, new - self.span, side="left")
        keep = both[both >= both[-1] - self.span]
        self.times.put([(int(x),) for x in keep])
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(int(both[-1] + self.span) // 1000 + 1)
        yield pd.DataFrame({"client_id": key[0], "id": frame["id"], "n": n, "allowed": n <= self.most})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()  # the timer of the last event: all others are older
        yield pd.DataFrame({"client_id": [], "id": [], "n": [], "allowed": []}).astype({"client_id": "int64", "id": "int64", "n": "int64", "allowed": "bool"})

    def close(self) -> None:
        pass


def throttled(logs: DataFrame, seconds: int, most: int) -> DataFrame:
    """(client_id, id, n, allowed): how many events of the client are in the trailing `seconds`, this one included, and whether that is within the limit (T14). logs needs a
    watermark on requested_at and batches in order of time; the state store must be RocksDB."""
    return logs.groupBy("client_id").transformWithStateInPandas(statefulProcessor=Throttle(seconds, most), outputStructType=THROTTLED, outputMode="Append", timeMode="EventTime")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over all that is there, into a table in memory: for tests and small results."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
