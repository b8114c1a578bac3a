"""Control queries: rate limits, ledgers, throttles, sessions, caches, queues, schedules and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.operators import limits as L
from vinlake.operators import shards as S
from vinlake.plans.registry import query
from vinlake.sources import domain as D


@query(
    f"""{D.with_tables("logs", "clients")}, r AS (SELECT l.*, c.per_day, c.per_month, c.per_vin, CAST(status_code BETWEEN 200 AND 299 AS INT) AS ok, CAST(requested_at AS DATE) AS d, strftime(requested_at, '%Y-%m') AS m FROM logs l JOIN clients c ON client_id = c.id),
n AS (SELECT *, coalesce(sum(ok) OVER (PARTITION BY client_id, d ORDER BY requested_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nd, coalesce(sum(ok) OVER (PARTITION BY client_id, m ORDER BY requested_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nm,
 coalesce(sum(ok) OVER (PARTITION BY client_id, m, vin ORDER BY requested_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nv FROM r)
SELECT id, client_id, CASE WHEN nd >= per_day THEN 'DAILY_LIMIT_EXCEEDED' WHEN nm >= per_month THEN 'MONTHLY_LIMIT_EXCEEDED' WHEN vin IS NOT NULL AND nv >= per_vin THEN 'VIN_LIMIT_EXCEEDED' ELSE 'allowed' END AS verdict, CAST(greatest(0, per_day - nd) AS BIGINT) AS daily_left FROM n WHERE per_day IS NOT NULL
UNION ALL SELECT id, client_id, CASE WHEN nm >= per_month THEN 'MONTHLY_LIMIT_EXCEEDED' WHEN vin IS NOT NULL AND nv >= per_vin THEN 'VIN_LIMIT_EXCEEDED' ELSE 'allowed' END, NULL FROM n WHERE per_day IS NULL"""
)
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the limits say to every request."""
    return L.rate_verdicts(D.request_logs(spark, sf_dir), D.clients(spark, sf_dir)).select("id", "client_id", "verdict", "daily_left")


@query(
    f"""{D.with_tables("clients")} SELECT o_orderkey AS order_id, o_custkey AS client_id, d AS delta, CAST(credit_balance + sum(d) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS balance_after
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS d FROM orders) JOIN clients ON o_custkey = id"""
)
def credit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances after each entry."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("delta"), "o_orderdate")
    return L.ledger(o, D.clients(spark, sf_dir), ["o_orderdate", "order_id"]).select("order_id", "client_id", "delta", "balance_after")


@query(
    f"""{D.with_tables("logs", "clients")} SELECT id, client_id, ok AND n <= credit_balance AS paid, CAST(greatest(0, credit_balance - n) AS BIGINT) AS balance_after FROM (SELECT l.id, client_id, credit_balance, status_code BETWEEN 200 AND 299 AS ok,
 sum(CAST(status_code BETWEEN 200 AND 299 AS INT)) OVER (PARTITION BY client_id ORDER BY requested_at, l.id ROWS UNBOUNDED PRECEDING) AS n FROM logs l JOIN clients c ON client_id = c.id)"""
)
def credit_spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which successes a credit was left for."""
    return L.spends(D.request_logs(spark, sf_dir), D.clients(spark, sf_dir), ["requested_at", "id"]).select("id", "client_id", "paid", "balance_after")


@query(
    f"""{D.with_tables("logs")} SELECT id, client_id, count(*) OVER w AS n, count(*) OVER w <= 2 AS allowed FROM logs WINDOW w AS (PARTITION BY client_id ORDER BY requested_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)"""
)
def support_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two events in a trailing six hours."""
    return L.throttled(D.request_logs(spark, sf_dir), "client_id", "requested_at", 6 * 3600, 2).select("id", "client_id", "n", "allowed")


@query(
    f"""{D.with_tables("logs")} SELECT client_id, began, ended, CAST(floor(epoch(ended - began)) AS BIGINT) AS quiet_s FROM (SELECT client_id, lag(requested_at) OVER (PARTITION BY client_id ORDER BY requested_at) AS began, requested_at AS ended FROM logs) WHERE ended - began > INTERVAL 24 HOUR"""
)
def quiet_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of over a day between a client's requests."""
    return L.quiet_spells(D.request_logs(spark, sf_dir), "client_id", "requested_at", 24 * 3600)


@query(
    f"""{D.with_tables("logs")}, f AS (SELECT client_id, requested_at, CASE WHEN requested_at - lag(requested_at) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM logs WINDOW w AS (PARTITION BY client_id ORDER BY requested_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY requested_at ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT client_id, min(requested_at) AS began, max(requested_at) AS ended, count(*) AS n FROM s GROUP BY client_id, k"""
)
def client_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of two hours."""
    return L.sessions(D.request_logs(spark, sf_dir), "client_id", "requested_at", 2 * 3600)


@query(f"""{D.with_tables("logs")} SELECT path, time_bucket(INTERVAL 3 HOUR, requested_at, TIMESTAMP '1970-01-01') AS began, count(*) AS requests, count(*) - 1 AS hits FROM logs GROUP BY 1, 2""")
def cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of three hours saves by path and span (T4)."""
    return L.cache_lives(D.request_logs(spark, sf_dir), ["path"], "requested_at", "3 hours")


_JOBS = "jobs AS (SELECT o_orderkey AS id, o_custkey % 5 AS provider_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'done' END AS status, o_orderpriority AS kind, o_orderdate AS created_at FROM orders)"


@query(f"""WITH {_JOBS} SELECT id, CASE kind WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 4 ELSE 3 END AS rank FROM jobs WHERE status = 'pending' ORDER BY rank, created_at, id LIMIT 4""")
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that four free slots claim."""
    k = F.col("o_orderpriority")
    jobs = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"), k.alias("kind")
    )
    rank = F.when(F.col("kind") == "1-URGENT", 0).when(F.col("kind") == "2-HIGH", 1).when(F.col("kind") == "5-LOW", 4).otherwise(3)
    return L.claimed(jobs, rank, 4, ["created_at", "id"]).select("id", "rank")


@query(
    f"""WITH RECURSIVE t AS (SELECT s_name AS name, s_name AS text, 0 AS start FROM supplier UNION ALL SELECT s_name, s_name || ':', 17 FROM supplier),
h AS (SELECT name, text, start, 0 AS i, CAST(start AS BIGINT) AS h FROM t UNION ALL SELECT name, text, start, i + 1, (h * 31 + ascii(substr(text, i + 1, 1))) % 4294967296 FROM h WHERE i < length(text)),
e AS (SELECT name, max(h) FILTER (start = 0) AS one, max(h) FILTER (start = 17) AS two FROM h WHERE i = length(text) GROUP BY name), r AS (SELECT *, [{", ".join(map(str, L.REPEAT_HOURS))}][one % {len(L.REPEAT_HOURS)} + 1] AS repeat_hours FROM e)
SELECT name AS internal_name, repeat_hours, CAST(two % greatest(30, repeat_hours * 60 - 15) AS BIGINT) AS stagger_minutes FROM r"""
)
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat hours and first starts by a stable hash of the name."""
    return L.schedule(D.providers(spark, sf_dir), "internal_name")


@query(
    """WITH s AS (SELECT o_custkey AS job_id, o_orderkey AS shard, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'cooldown' ELSE 'completed' END AS state, o_orderdate AS until FROM orders)
SELECT job_id, max(shard) FILTER (state = 'pending' OR (state = 'cooldown' AND until <= TIMESTAMP '1998-01-01')) AS shard, min(until) FILTER (state = 'cooldown' AND until > TIMESTAMP '1998-01-01') AS wakes_at FROM s GROUP BY job_id"""
)
def ready_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's next shard, and when it wakes otherwise."""
    s = F.col("o_orderstatus")
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("shard"), F.when(s == "O", "pending").when(s == "F", "cooldown").otherwise("completed").alias("state"), F.col("o_orderdate").alias("until"))
    return L.ready_shards(rows, "1998-01-01 00:00:00")


@query(
    f"""{D.with_tables("listings")}, c AS (SELECT price_amount AS v, count(*) AS n FROM listings WHERE price_amount IS NOT NULL GROUP BY 1),
r AS (SELECT v, n, n > 250 AS big, sum(n) OVER (ORDER BY v) - n AS before, sum(CAST(n > 250 AS INT)) OVER (ORDER BY v) AS bigs FROM c)
SELECT min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY bigs, CASE WHEN big THEN -1 ELSE before // 250 END"""
)
def price_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ranges of at most 500 listings."""
    return L.range_shards(D.listings(spark, sf_dir), "price_amount", 500)


@query(
    f"""{D.with_tables("logs")} SELECT CAST(CAST(requested_at AS DATE) AS TIMESTAMP) AS day, count(*) AS n, count(*) FILTER (status_code >= 400) AS errors FROM logs GROUP BY 1"""
)
def intake_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling daily windows."""
    logs = D.request_logs(spark, sf_dir)
    out = logs.groupBy(F.window("requested_at", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    return out.select(F.col("window.start").alias("day"), "n", "errors")


_LOG = """log AS (SELECT user_id AS shard, ts AS came, event_id, CASE WHEN k = 7 THEN 'reset' WHEN k < 4 THEN 'last' WHEN event_type = 'error' OR (k > 60 AND user_id % 3 = 0) THEN 'failed' WHEN event_type = 'purchase' THEN 'blocked' ELSE 'page' END AS kind,
  ts + INTERVAL 1 HOUR * (k % 48) AS until, CASE WHEN event_type = 'view' THEN k END AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


@query(
    f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY came, event_id) AS i, count(*) OVER (PARTITION BY shard) AS m FROM log),
f AS (SELECT DISTINCT shard, CAST(0 AS BIGINT) AS i, m, 'pending' AS status, 0 AS failures, CAST(NULL AS TIMESTAMP) AS until, CAST(1 AS BIGINT) AS next_page, CAST(0 AS BIGINT) AS fetched FROM o
  UNION ALL SELECT f.shard, o.i, f.m, CASE WHEN kind = 'reset' THEN 'pending' WHEN status = 'completed' THEN 'completed' WHEN kind = 'page' THEN 'pending' WHEN kind = 'last' THEN 'completed' WHEN kind = 'failed' THEN CASE WHEN failures + 1 >= 5 THEN 'completed' ELSE 'pending' END ELSE 'cooldown' END,
    CASE WHEN kind = 'reset' THEN 0 WHEN status = 'completed' THEN failures WHEN kind IN ('page', 'last') THEN 0 ELSE least(failures + 1, 8) END, CASE WHEN kind = 'reset' THEN NULL WHEN status = 'completed' THEN f.until WHEN kind = 'blocked' THEN o.until END,
    CASE WHEN kind = 'reset' THEN 1 WHEN status = 'completed' OR kind = 'blocked' THEN next_page ELSE next_page + 1 END, CASE WHEN kind = 'reset' THEN 0 WHEN status <> 'completed' AND kind IN ('page', 'last') THEN fetched + coalesce(n, 0) ELSE fetched END
  FROM f JOIN o ON o.shard = f.shard AND o.i = f.i + 1)
SELECT shard, CASE WHEN status = 'cooldown' AND until <= TIMESTAMP '2024-01-31' THEN 'pending' ELSE status END AS status, failures, CASE WHEN status = 'cooldown' AND until > TIMESTAMP '2024-01-31' THEN until END AS wakes_at, next_page, fetched, failures >= 8 AND fetched = 0 AS chronic FROM f WHERE i = m"""
)
def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each shard stands after its log: composed transitions against the twin's replay, one entry after the other."""
    e, k = D.table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("int")
    failed = (F.col("event_type") == "error") | ((k > 60) & (F.col("user_id") % 3 == 0))
    kind = F.when(k == 7, "reset").when(k < 4, "last").when(failed, "failed").when(F.col("event_type") == "purchase", "blocked").otherwise("page")
    log = e.select(F.col("user_id").alias("shard"), F.col("ts").alias("at"), "event_id", kind.alias("kind"), (F.col("ts") + F.make_dt_interval(F.lit(0), k % 48)).alias("until"), F.when(F.col("event_type") == "view", k).alias("n"))
    return S.shard_states(log, "shard", "at", ["event_id"], D.AS_OF)


@query(f"""{D.with_tables("vehicles", "listings")} SELECT year, CAST(count(*) AS BIGINT) AS n, min(price_amount) AS low, max(price_amount) AS high, CAST(0 AS BIGINT) AS too_large FROM listings JOIN vehicles ON vehicle_id = id GROUP BY year""")
def box_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of at most 500 listings over year, make, price and mileage, summed up by year: every listing is in one box, and no box that could be cut is too large."""
    v = D.vehicles(spark, sf_dir).select(F.col("id").alias("vehicle_id"), "year", "make")
    rows, boxes = S.box_shards(D.listings(spark, sf_dir).join(v, "vehicle_id").select("year", "make", "price_amount", "mileage"), ["year", "make", "price_amount", "mileage"], 500)
    found = rows.groupBy("box", "year").agg(F.count(F.lit(1)).alias("in_box"), F.min("price_amount").alias("low"), F.max("price_amount").alias("high"))
    both = found.join(boxes.select("box", F.col("n").alias("said"), "splittable"), "box")
    large = F.count_if(((F.col("said") > 500) & F.col("splittable")) | (F.col("said") < F.col("in_box")))
    return both.groupBy("year").agg(F.sum("in_box").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), large.alias("too_large"))
