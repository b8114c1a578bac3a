"""Stateful control as windows over ordered requests: rate limits, ledgers, throttles, quiet spells, caches, queues and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinlake.functions.text import poly_hash

# Fixed values.
REPEAT_HOURS = (4, 5, 6)
WINDOW_RESULTS = 10_000


def rate_verdicts(logs: DataFrame, clients: DataFrame) -> DataFrame:
    """(id, client_id, verdict, daily_left, monthly_left): what the limits said when a request came (T3). Earlier successes of the client count, by UTC day, by month,
    and by month and vin; the checks run in that order. A client without a limit has none.

    One shuffle by client: all three windows partition by it first."""
    ok = F.when(F.col("status_code").between(200, 299), 1).otherwise(0)
    before = lambda *keys: F.coalesce(F.sum("_ok").over(Window.partitionBy("client_id", *keys).orderBy("requested_at", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = logs.join(clients.select(F.col("id").alias("client_id"), "per_day", "per_month", "per_vin"), "client_id")
    rows = rows.withColumns({"_ok": ok, "_d": F.to_date("requested_at"), "_m": F.date_format("requested_at", "yyyy-MM")})
    rows = rows.withColumns({"_nd": before("_d"), "_nm": before("_m"), "_nv": before("_m", "vin")})
    verdict = F.when(F.col("_nd") >= F.col("per_day"), "DAILY_LIMIT_EXCEEDED").when(F.col("_nm") >= F.col("per_month"), "MONTHLY_LIMIT_EXCEEDED").when(F.col("vin").isNotNull() & (F.col("_nv") >= F.col("per_vin")), "VIN_LIMIT_EXCEEDED").otherwise("allowed")
    left = lambda limit, n: F.when(F.col(limit).isNotNull(), F.greatest(F.lit(0), F.col(limit) - F.col(n)))
    return rows.select("id", "client_id", verdict.alias("verdict"), left("per_day", "_nd").alias("daily_left"), left("per_month", "_nm").alias("monthly_left"))


def ledger(entries: DataFrame, opening: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Entries (client_id, delta, ...) with balance_after: the opening balance (id, credit_balance) and all deltas so far."""
    w = Window.partitionBy("client_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entries.join(opening.select(F.col("id").alias("client_id"), "credit_balance"), "client_id")
    return rows.withColumn("balance_after", F.col("credit_balance") + F.sum("delta").over(w)).drop("credit_balance")


def spends(requests: DataFrame, opening: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Requests with `paid` and balance_after (T12): each success takes one credit while one is left. With debits of one alone the n-th success is paid if n is at most
    the opening balance, so no state has to be kept."""
    w = Window.partitionBy("client_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = requests.join(opening.select(F.col("id").alias("client_id"), "credit_balance"), "client_id")
    rows = rows.withColumn("_n", F.sum(F.when(F.col("status_code").between(200, 299), 1).otherwise(0)).over(w))
    paid = F.col("status_code").between(200, 299) & (F.col("_n") <= F.col("credit_balance"))
    return rows.withColumns({"paid": paid, "balance_after": F.greatest(F.lit(0), F.col("credit_balance") - F.col("_n"))}).drop("credit_balance", "_n")


def throttled(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Events with n (those of the key in the trailing window, this one included) and `allowed`."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("n") <= most)


def quiet_spells(beats: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, began, ended, quiet_s): gaps between consecutive heartbeats of a key that are longer than `seconds`."""
    w = Window.partitionBy(key).orderBy(ts)
    rows = beats.select(key, F.lag(ts).over(w).alias("began"), F.col(ts).alias("ended"))
    gap = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))
    return rows.withColumn("quiet_s", F.floor(gap / 1_000_000)).filter(gap > seconds * 1_000_000)


def sessions(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, began, ended, n): runs of a key's events without a gap of `seconds` or more (T7), by session windows. ended: the last event."""
    t = F.col(ts).cast("timestamp")
    out = events.groupBy(key, F.session_window(t, f"{seconds} seconds")).agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return out.drop("session_window")


def cache_lives(requests: DataFrame, key: Sequence[str], ts: str, life: str) -> DataFrame:
    """(key, began, requests, hits): what a cache saves whose entries live for a span of a fixed grid (T4): of a key's requests in a span all but the first are hits.
    Counts are summed up within tasks first, so a path that a third of all requests share is no load."""
    out = requests.groupBy(*key, F.window(F.col(ts).cast("timestamp"), life).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return out.select(*key, F.col("w.start").cast("timestamp_ntz").alias("began"), "requests", (F.col("requests") - 1).alias("hits"))


def claimed(jobs: DataFrame, rank: Column, slots: int, ties: Sequence[Column | str]) -> DataFrame:
    """The pending jobs that free slots take (T8, O4): the best rank first. The limit holds before the merge, so no task sorts all jobs."""
    return jobs.filter("status = 'pending'").withColumn("rank", rank).orderBy("rank", *ties).limit(slots)


def schedule(names: DataFrame, name: str) -> DataFrame:
    """(name, repeat_hours, stagger_minutes) by a stable hash of the name."""
    hours = F.get(F.array(*map(F.lit, REPEAT_HOURS)), (poly_hash(F.col(name)) % len(REPEAT_HOURS)).cast("int"))
    out = names.select(name, hours.alias("repeat_hours"))
    span = F.greatest(F.lit(30), F.col("repeat_hours") * 60 - 15)
    return out.withColumn("stagger_minutes", (poly_hash(F.concat(name, F.lit(":")), 17) % span).cast("long"))


def ready_shards(shards: DataFrame, as_of: str) -> DataFrame:
    """(job_id, shard, wakes_at): each job's next shard (T10): the newest that is pending, or out of its cooldown; else none, and when the first cooldown ends."""
    now = F.lit(as_of).cast("timestamp_ntz")
    ready = (F.col("state") == "pending") | ((F.col("state") == "cooldown") & (F.col("until") <= now))
    return shards.groupBy("job_id").agg(F.max(F.when(ready, F.col("shard"))).alias("shard"), F.min(F.when((F.col("state") == "cooldown") & (F.col("until") > now), F.col("until"))).alias("wakes_at"))


def range_shards(values: DataFrame, column: str, most: int = WINDOW_RESULTS) -> DataFrame:
    """(low, high, n): ranges of a whole number that hold at most `most` rows each where values allow it (T11). Rows are counted by value first; running counts then cut
    the values, so no range is bisected by a loop. A value with more rows than that is a range of its own."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # Running sums over values in parts of a fixed width, and then over the parts, keep the global order out of one task.
    counts = counts.withColumns({"p": F.floor(F.col("v") / 1024), "big": F.when(F.col("n") > most // 2, 1).otherwise(0)})
    parts = counts.groupBy("p").agg(F.sum("n").alias("pn"), F.sum("big").alias("pb"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part alone
    parts = parts.select("p", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("pn", "pb")))
    inside = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.join(parts, "p").select("v", "n", "big", (F.col("pn") + F.sum("n").over(inside) - F.col("n")).alias("before"), (F.col("pb") + F.sum("big").over(inside)).alias("bigs"))
    # A large value ends the range before it and stands alone.
    group = F.when(F.col("big") == 1, F.struct(F.col("bigs"), F.lit(-1).cast("long").alias("k"))).otherwise(F.struct(F.col("bigs"), F.floor(F.col("before") / (most // 2)).alias("k")))
    return rows.withColumn("g", group).groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).drop("g")
