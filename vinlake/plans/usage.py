"""Usage analytics over request logs: series, summaries, rankings and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.functions.numbers import half_up, share_percent
from vinlake.functions.text import outcome, path_class
from vinlake.operators import ranks as K
from vinlake.operators.windows import gap_filled
from vinlake.plans.registry import query
from vinlake.sources import domain as D

SINCE, UNTIL = "2024-01-01 00:00:00", "2024-01-30 23:59:59"
TODAY, WEEK, MONTH = "2024-01-30 00:00:00", "2024-01-24 00:00:00", "2024-01-01 00:00:00"


def measures(ok: Column, error: Column, kind: Column) -> list[Column]:
    """Counts of a bucket, its mean duration (halves up) and exact 95th percentile (to even): all in one aggregate."""
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(error).alias("errors"), F.count_if(kind == "vin").alias("vin"), F.count_if(kind == "check").alias("check"), F.count_if(kind == "live").alias("live"),
        half_up(F.avg("duration_ms")).alias("avg_ms"), F.rint(F.percentile("duration_ms", 0.95)).cast("long").alias("p95_ms"),
    ]


def series(logs: DataFrame, since: str, until: str, unit: str) -> DataFrame:
    """Measures of each UTC hour or day of the range, zeros where nothing happened."""
    at = F.col("requested_at")
    rows = logs.filter((at >= F.lit(since).cast("timestamp_ntz")) & (at <= F.lit(until).cast("timestamp_ntz")))
    bucket = F.date_trunc(unit, at).cast("timestamp_ntz").alias("bucket")
    found = rows.groupBy(bucket).agg(*measures(F.col("status_code").between(200, 299), F.col("status_code") >= 400, path_class(F.col("path"))))
    return gap_filled(logs.sparkSession, found, "bucket", since, until, unit)


_MEASURES = """count(*) AS total, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok, count(*) FILTER (status_code >= 400) AS errors,
 count(*) FILTER (path LIKE '%/v1/vin/%' AND path NOT LIKE '%/check/%') AS vin, count(*) FILTER (path LIKE '%/vin/check/%') AS "check", count(*) FILTER (path LIKE '%/v1/live/%') AS live,
 CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_ms, CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS BIGINT) AS p95_ms"""


def _series_sql(unit: str, since: str, until: str) -> str:
    cols = ("total", "ok", "errors", "vin", '"check"', "live", "avg_ms", "p95_ms")
    return f"""{D.with_tables("logs")}, s AS (SELECT date_trunc('{unit}', requested_at) AS bucket, {_MEASURES} FROM logs WHERE requested_at BETWEEN TIMESTAMP '{since}' AND TIMESTAMP '{until}' GROUP BY 1),
c AS (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{since}'), date_trunc('{unit}', TIMESTAMP '{until}'), INTERVAL 1 {unit})) AS bucket)
SELECT CAST(c.bucket AS TIMESTAMP) AS bucket, {", ".join(f"coalesce({x}, 0) AS {x}" for x in cols)} FROM c LEFT JOIN s ON c.bucket = s.bucket"""


@query(_series_sql("day", SINCE, UNTIL))
def usage_series_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(D.request_logs(spark, sf_dir), SINCE, UNTIL, "day")


@query(_series_sql("hour", "2024-01-29 00:00:00", UNTIL))
def usage_series_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(D.request_logs(spark, sf_dir), "2024-01-29 00:00:00", UNTIL, "hour")


@query(
    f"""{D.with_tables("logs")} SELECT count(*) FILTER (requested_at >= TIMESTAMP '{TODAY}') AS today, count(*) FILTER (requested_at >= TIMESTAMP '{WEEK}') AS week, count(*) FILTER (requested_at >= TIMESTAMP '{MONTH}') AS month,
 count(*) AS all_time, count(*) FILTER (requested_at >= TIMESTAMP '{WEEK}' AND status_code >= 400) AS errors_week, count(DISTINCT vin) AS unique_vins, count(DISTINCT client_id) FILTER (status_code BETWEEN 200 AND 299) AS ok_clients,
 CAST(floor(count(*) FILTER (status_code BETWEEN 200 AND 299) / count(*) * 100 + 0.5) AS BIGINT) AS success_rate,
 CAST(floor(count(*) FILTER (requested_at >= TIMESTAMP '{TODAY}') / count(*) FILTER (requested_at >= TIMESTAMP '{WEEK}') * 100 + 0.5) AS BIGINT) AS today_share,
 CAST(floor((count(*) FILTER (requested_at >= TIMESTAMP '{WEEK}') - count(*) FILTER (requested_at >= TIMESTAMP '2024-01-17' AND requested_at < TIMESTAMP '{WEEK}')) / count(*) FILTER (requested_at >= TIMESTAMP '2024-01-17' AND requested_at < TIMESTAMP '{WEEK}') * 100 + 0.5) AS BIGINT) AS week_delta FROM logs"""
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing windows, distinct counts, rates and the change between weeks, in one pass."""
    logs, at = D.request_logs(spark, sf_dir), F.col("requested_at")
    since = lambda x: at >= F.lit(x).cast("timestamp_ntz")
    ok = F.col("status_code").between(200, 299)
    before = since("2024-01-17") & ~since(WEEK)
    out = logs.agg(
        F.count_if(since(TODAY)).alias("today"), F.count_if(since(WEEK)).alias("week"), F.count_if(since(MONTH)).alias("month"), F.count(F.lit(1)).alias("all_time"), F.count_if(since(WEEK) & (F.col("status_code") >= 400)).alias("errors_week"),
        F.count_distinct("vin").alias("unique_vins"), F.count_distinct(F.when(ok, F.col("client_id"))).alias("ok_clients"), F.count_if(ok).alias("_ok"), F.count_if(before).alias("_before"),
    )
    return out.select(
        "today", "week", "month", "all_time", "errors_week", "unique_vins", "ok_clients", share_percent(F.col("_ok"), F.col("all_time")).alias("success_rate"), share_percent(F.col("today"), F.col("week")).alias("today_share"),
        share_percent(F.col("week") - F.col("_before"), F.col("_before")).alias("week_delta"),
    )


@query(
    f"""{D.with_tables("logs", "clients")} SELECT vin, client_id, name AS client_name, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors, max(requested_at) AS last_at
FROM logs LEFT JOIN clients ON client_id = clients.id WHERE vin IS NOT NULL GROUP BY ALL ORDER BY requests DESC, vin, client_id LIMIT 25"""
)
def usage_top_vins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most requested identifiers by client (J2, A11, O3). Logs are summed up before the client's name is joined."""
    logs = D.request_logs(spark, sf_dir).filter("vin IS NOT NULL")
    top = logs.groupBy("vin", "client_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.max("requested_at").alias("last_at"))
    top = top.orderBy(F.col("requests").desc(), "vin", "client_id").limit(25)
    return top.join(D.clients(spark, sf_dir).select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left").select("vin", "client_id", "client_name", "requests", "errors", "last_at")


@query(f"""{D.with_tables("logs")} SELECT path, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM logs GROUP BY path""")
def exact_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 95th percentile of durations by path, in bounded memory (A5)."""
    return K.exact_percentile(D.request_logs(spark, sf_dir), ["path"], "duration_ms", 0.95).select("path", F.round("value", 6).alias("p95_ms"))


@query(f"""{D.with_tables("logs")} SELECT vin, count(*) AS n FROM logs WHERE vin IS NOT NULL GROUP BY vin ORDER BY n DESC, vin LIMIT 25""")
def heavy_vins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most requested identifiers, without a count of every one (O3)."""
    return K.heavy_top(D.request_logs(spark, sf_dir).filter("vin IS NOT NULL"), ["vin"], 25)


@query(f"""{D.with_tables("logs")} SELECT path, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors FROM logs GROUP BY path ORDER BY requests DESC, path LIMIT 12""")
def usage_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 busiest paths (O3)."""
    out = D.request_logs(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    return out.orderBy(F.col("requests").desc(), "path").limit(12)


@query(
    f"""{D.with_tables("logs")} SELECT status_code, count(*) AS n, CASE WHEN status_code < 400 THEN NULL WHEN status_code = 400 THEN 'Invalid VIN' WHEN status_code IN (401, 403) THEN 'Auth / blocked' WHEN status_code = 402 THEN 'No credits'
 WHEN status_code = 404 THEN 'Not found' WHEN status_code = 429 THEN 'Rate limited' WHEN status_code >= 500 THEN 'Server error' ELSE 'HTTP ' || status_code END AS reason
FROM logs WHERE path LIKE '%/v1/vin/%' AND path NOT LIKE '%/check/%' GROUP BY status_code"""
)
def usage_vin_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of vin reports, and why they failed."""
    logs = D.request_logs(spark, sf_dir).filter(path_class(F.col("path")) == "vin")
    return logs.groupBy("status_code").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.when(F.col("status_code") >= 400, outcome(F.col("status_code"))))


@query(
    f"""{D.with_tables("logs", "clients")}, a AS (SELECT client_id, count(*) AS all_time, count(*) FILTER (requested_at >= TIMESTAMP '{TODAY}') AS today, count(*) FILTER (status_code >= 400) AS errors, max(requested_at) AS last_request FROM logs GROUP BY client_id),
o AS (SELECT o_custkey AS client_id, max(o_orderdate) AS last_order, count(*) AS orders FROM orders GROUP BY o_custkey)
SELECT id AS client_id, name, credit_balance, coalesce(all_time, 0) AS all_time, coalesce(today, 0) AS today, coalesce(errors, 0) AS errors, coalesce(orders, 0) AS orders, greatest(last_request, last_order) AS last_seen FROM clients LEFT JOIN a ON id = a.client_id LEFT JOIN o ON id = o.client_id"""
)
def usage_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client with its counts and the later of two last signs of life."""
    logs, orders = D.request_logs(spark, sf_dir), D.table(spark, sf_dir, "orders")
    a = logs.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("all_time"), F.count_if(F.col("requested_at") >= F.lit(TODAY).cast("timestamp_ntz")).alias("today"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.max("requested_at").alias("last_request")
    )
    o = orders.groupBy(F.col("o_custkey").alias("client_id")).agg(F.max("o_orderdate").alias("last_order"), F.count(F.lit(1)).alias("orders"))
    out = D.clients(spark, sf_dir).select(F.col("id").alias("client_id"), "name", "credit_balance").join(a, "client_id", "left").join(o, "client_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("client_id", "name", "credit_balance", *map(zero, ("all_time", "today", "errors", "orders")), F.greatest("last_request", "last_order").alias("last_seen"))


@query(
    f"""{D.with_tables("logs")} SELECT id, client_id, path, status_code FROM logs WHERE requested_at > TIMESTAMP '{D.AS_OF}' - INTERVAL 72 HOUR AND status_code BETWEEN 400 AND 499 AND upper(vin) LIKE 'C%' """
)
def usage_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composed filter of logs: relative time, status class and identifier prefix."""
    from vinlake.operators.filters import status_class, within

    logs = D.request_logs(spark, sf_dir)
    return logs.filter(within(F.col("requested_at"), D.AS_OF, "72 HOURS") & status_class(F.col("status_code"), "4xx") & F.upper("vin").like("C%")).select("id", "client_id", "path", "status_code")
