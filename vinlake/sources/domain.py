"""The domain's tables, derived from the driver's: vehicles, listings, observations, events, photos, request logs, ledgers.

Every table is a plain projection of a scan, so filters and column pruning reach Parquet. SQL holds the same derivations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.functions import vin as V
from vinlake.functions.once import bound

#: The moment that queries take as now.
AS_OF = "2024-01-31 00:00:00"
MODELS = ("5er", "3-series", "c class", "GLC-class", "7 Series")
FUELS = ("Diesel", "PETROL", "Plug-in Hybrid", "ДИЗЕЛЬ", "디젤", "gas/electric hybrid", "EV", "LPG", "unknown", "warp core")
PLACES = ("kr", "USA", "u.s.a.", "Deutschland", "Norge", "south_korea", "Atlantis")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, internal_name, country, type, enabled): suppliers, their nation and region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("internal_name"), F.col("n_name").alias("country"), F.col("r_name").alias("type"), (F.col("s_suppkey") % 7 != 0).alias("enabled"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vin, make, model, trim, year, fuel_type, country): parts. A third of the identifiers get their check digit."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = F.substring(F.upper(F.md5(k.cast("string").cast("binary"))), 1, 17)
    raw = bound(raw, lambda r: F.when(k % 3 == 0, F.concat(F.substring(r, 1, 8), V.check_digit(r), F.substring(r, 10, 8))).otherwise(r))
    return p.select(
        k.alias("id"), raw.alias("vin"), F.col("p_brand").alias("make"), F.when(k % 2 == 0, _pick(MODELS, k % len(MODELS))).otherwise(F.col("p_name")).alias("model"), F.col("p_type").alias("trim"),
        (1990 + F.col("p_size") % 35).cast("int").alias("year"), _pick(FUELS, k % len(FUELS)).alias("fuel_type"), _pick(PLACES, k % len(PLACES)).alias("country"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vehicle_id, provider_id, source_id, price_amount, price_currency, mileage, mileage_unit, listing_status, location, seen_at): line items, repeats and all."""
    x = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_discount") >= 0.09, "Sold").when(F.col("l_linestatus") == "O", "active").otherwise(" Inactive ")
    return x.select(
        F.col("l_partkey").alias("vehicle_id"), F.col("l_suppkey").alias("provider_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"),
        F.when(F.col("l_tax") < 0.08, F.floor(F.col("l_extendedprice") / 1000).cast("long")).alias("price_amount"), _currency().alias("price_currency"),
        F.floor(F.col("l_quantity") / 10).cast("long").alias("step"), (F.floor(F.col("l_quantity") / 10) * 10000).cast("long").alias("mileage"),
        F.when(F.col("l_linestatus") == "O", "mi").otherwise("km").alias("mileage_unit"), status.alias("listing_status"),
        F.concat(F.lit("Yard  "), F.col("l_linenumber").cast("string")).alias("location"), F.col("l_shipdate").alias("seen_at"),
    ).drop("step")


def _currency() -> Column:
    return F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "N", "EUR").otherwise("KRW")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vehicle_id, order_id, line, event_type, description, metadata, occurred_at): line items with their order; metadata is JSON text."""
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("long"), F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "accident").when(p == "2-HIGH", "owner_change").when(p == "3-MEDIUM", "sale").when(p == "4-NOT SPECIFIED", "inspection").otherwise("delivery")
    desc = (
        F.when(kind == "accident", F.concat(F.lit("Accident at "), (q * 1000).cast("string"), F.lit(" km"))).when(kind == "owner_change", F.lit("Owner change"))
        .when(kind == "sale", F.concat(F.lit("Final price: $"), (q * 100).cast("string"))).when(kind == "inspection", F.lit("Inspection"))
        .when(F.col("l_linenumber") % 2 == 0, "New car shipment").otherwise("New car delivery")
    )
    meta = F.to_json(F.struct(
        F.when(F.col("l_linenumber") % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.when(kind.isin("inspection", "owner_change"), q * 900).alias("mileageKm"),
        F.when(kind == "sale", F.concat(q.cast("string"), F.lit(",000 mi"))).alias("odometer"), F.when(kind == "accident", q * 7).alias("partCost"), F.when(kind == "accident", q * 3).alias("laborCost"),
        F.when((kind == "owner_change") & (F.col("l_linenumber") > 3), F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))).alias("plate"),
        F.when((kind == "sale") & (F.col("l_linenumber") > 4), q * 100).alias("priceAmount"), _currency().alias("currency"),
        F.when(kind == "delivery", F.when(q % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy"))).alias("value"),
        F.when(kind == "delivery", "firstRegistration").alias("field"), F.when(F.col("l_suppkey") % 4 == 0, "registry").otherwise("auction").alias("source"),
    ))
    both = x.join(o, x.l_orderkey == o.o_orderkey)
    return both.select(
        F.col("l_partkey").alias("vehicle_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("provider_id"), kind.alias("event_type"), desc.alias("description"),
        meta.alias("metadata"), F.col("o_orderdate").alias("occurred_at"),
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vehicle_id, listing_id, source_url, is_primary, sort_order, photo_group): a picture for each line item; sizes and queries vary."""
    x = table(spark, sf_dir, "lineitem")
    size = F.when(F.col("l_suppkey") % 3 == 0, "/640x480").when(F.col("l_suppkey") % 3 == 1, "/1024x768").otherwise("")
    url = F.concat(F.lit("https://www.cdn.example.com/lot/"), F.col("l_partkey").cast("string"), size, F.lit("/frame_"), F.col("l_quantity").cast("int").cast("string"), F.lit(".jpg?w="), F.col("l_linenumber").cast("string"))
    return x.select(
        F.col("l_partkey").alias("vehicle_id"), F.col("l_suppkey").alias("listing_id"), F.when(F.col("l_discount") > 0.09, "https://cdn.example.com/logo.png").otherwise(url).alias("source_url"),
        (F.col("l_linenumber") == 1).alias("is_primary"), F.col("l_linenumber").cast("int").alias("sort_order"), F.when(F.col("l_tax") > 0.07, "exterior_3d").otherwise("gallery").alias("photo_group"),
    )


def request_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, client_id, vin, path, status_code, duration_ms, requested_at): events. The status follows from props, the path from the type."""
    e = table(spark, sf_dir, "events")
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    vin = F.substring(F.upper(F.md5((F.col("event_id") % 97).cast("string").cast("binary"))), 1, 17)
    path = F.when(kind.isin("view", "error"), F.concat(F.lit("/v1/vin/"), vin)).when(kind == "click", F.concat(F.lit("/v1/vin/check/"), vin)).when(kind == "purchase", "/v1/live/vehicles").otherwise("/v1/test-vins")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("client_id"), F.when(kind.isin("view", "error", "click"), vin).alias("vin"), path.alias("path"),
        F.when(k < 70, 200).when(k < 75, 400).when(k < 80, 401).when(k < 85, 404).when(k < 95, 429).otherwise(500).alias("status_code"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), F.col("ts").alias("requested_at"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, credit_balance, per_day, per_month, per_vin): customers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_name").alias("name"), F.floor(F.abs("c_acctbal") / 1000).cast("long").alias("credit_balance"), F.when(k % 4 != 0, 3 + k % 5).alias("per_day"), F.when(k % 3 != 0, 40 + k % 7).alias("per_month"),
        F.when(k % 2 == 0, F.lit(2).cast("long")).alias("per_vin"),
    )


def _array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_DIGITS = " + ".join(
    f"{w} * CAST(translate(substr(raw, {i + 1}, 1), '{V.LETTERS}', '{V.LETTER_VALUES}') AS INT)" for i, w in enumerate(V.WEIGHTS) if w
)
#: Common table expressions of the same tables for DuckDB; a query names those that it takes.
SQL = {
    "providers": "providers AS (SELECT s_suppkey AS id, s_name AS internal_name, n_name AS country, r_name AS type, s_suppkey % 7 <> 0 AS enabled FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "vehicles": f"""vehicle_raw AS (SELECT *, substr(upper(md5(CAST(p_partkey AS VARCHAR))), 1, 17) AS raw FROM part),
vehicle_digit AS (SELECT *, ({_DIGITS}) % 11 AS digit FROM vehicle_raw),
vehicles AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN substr(raw, 1, 8) || CASE WHEN digit = 10 THEN 'X' ELSE CAST(digit AS VARCHAR) END || substr(raw, 10, 8) ELSE raw END AS vin, p_brand AS make,
  CASE WHEN p_partkey % 2 = 0 THEN {_array(MODELS)}[p_partkey % {len(MODELS)} + 1] ELSE p_name END AS model, p_type AS trim, CAST(1990 + p_size % 35 AS INT) AS year,
  {_array(FUELS)}[p_partkey % {len(FUELS)} + 1] AS fuel_type, {_array(PLACES)}[p_partkey % {len(PLACES)} + 1] AS country FROM vehicle_digit)""",
    "listings": """listings AS (SELECT l_partkey AS vehicle_id, l_suppkey AS provider_id, l_orderkey || '-' || l_linenumber AS source_id, CASE WHEN l_tax < 0.08 THEN CAST(floor(l_extendedprice / 1000) AS BIGINT) END AS price_amount,
  CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'EUR' ELSE 'KRW' END AS price_currency, CAST(floor(l_quantity / 10) * 10000 AS BIGINT) AS mileage, CASE l_linestatus WHEN 'O' THEN 'mi' ELSE 'km' END AS mileage_unit,
  CASE WHEN l_discount >= 0.09 THEN 'Sold' WHEN l_linestatus = 'O' THEN 'active' ELSE ' Inactive ' END AS listing_status, 'Yard  ' || l_linenumber AS location, l_shipdate AS seen_at FROM lineitem)""",
    "events": """events0 AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, CASE o_orderpriority WHEN '1-URGENT' THEN 'accident' WHEN '2-HIGH' THEN 'owner_change' WHEN '3-MEDIUM' THEN 'sale' WHEN '4-NOT SPECIFIED' THEN 'inspection' ELSE 'delivery' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
vehicle_events AS (SELECT l_partkey AS vehicle_id, l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS provider_id, kind AS event_type,
  CASE kind WHEN 'accident' THEN 'Accident at ' || q * 1000 || ' km' WHEN 'owner_change' THEN 'Owner change' WHEN 'sale' THEN 'Final price: $' || q * 100 WHEN 'inspection' THEN 'Inspection' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'New car shipment' ELSE 'New car delivery' END END AS description,
  CASE WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS m_date, CASE WHEN kind IN ('inspection', 'owner_change') THEN q * 900 END AS m_km, CASE WHEN kind = 'sale' THEN q || ',000 mi' END AS m_odometer,
  CASE WHEN kind = 'accident' THEN q * 7 END AS m_part, CASE WHEN kind = 'accident' THEN q * 3 END AS m_labor, CASE WHEN kind = 'owner_change' AND l_linenumber > 3 THEN 'P' || l_suppkey END AS m_plate,
  CASE WHEN kind = 'sale' AND l_linenumber > 4 THEN q * 100 END AS m_price, CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'EUR' ELSE 'KRW' END AS m_currency,
  CASE WHEN kind = 'delivery' THEN CASE WHEN q % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y') END END AS m_value, CASE WHEN kind = 'delivery' THEN 'firstRegistration' END AS m_field,
  CASE WHEN l_suppkey % 4 = 0 THEN 'registry' ELSE 'auction' END AS m_source, o_orderdate AS occurred_at, q FROM events0)""",
    "photos": """photos AS (SELECT l_partkey AS vehicle_id, l_suppkey AS listing_id, CASE WHEN l_discount > 0.09 THEN 'https://cdn.example.com/logo.png' ELSE 'https://www.cdn.example.com/lot/' || l_partkey ||
  CASE l_suppkey % 3 WHEN 0 THEN '/640x480' WHEN 1 THEN '/1024x768' ELSE '' END || '/frame_' || CAST(l_quantity AS INT) || '.jpg?w=' || l_linenumber END AS source_url, l_linenumber = 1 AS is_primary, CAST(l_linenumber AS INT) AS sort_order,
  CASE WHEN l_tax > 0.07 THEN 'exterior_3d' ELSE 'gallery' END AS photo_group FROM lineitem)""",
    "logs": """logs0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, substr(upper(md5(CAST(event_id % 97 AS VARCHAR))), 1, 17) AS v FROM events),
logs AS (SELECT event_id AS id, user_id AS client_id, CASE WHEN event_type IN ('view', 'error', 'click') THEN v END AS vin,
  CASE WHEN event_type IN ('view', 'error') THEN '/v1/vin/' || v WHEN event_type = 'click' THEN '/v1/vin/check/' || v WHEN event_type = 'purchase' THEN '/v1/live/vehicles' ELSE '/v1/test-vins' END AS path,
  CASE WHEN k < 70 THEN 200 WHEN k < 75 THEN 400 WHEN k < 80 THEN 401 WHEN k < 85 THEN 404 WHEN k < 95 THEN 429 ELSE 500 END AS status_code, CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts AS requested_at FROM logs0)""",
    "clients": """clients AS (SELECT c_custkey AS id, c_name AS name, CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) AS credit_balance, CASE WHEN c_custkey % 4 <> 0 THEN 3 + c_custkey % 5 END AS per_day,
  CASE WHEN c_custkey % 3 <> 0 THEN 40 + c_custkey % 7 END AS per_month, CASE WHEN c_custkey % 2 = 0 THEN 2 END AS per_vin FROM customer)""",
}


def with_tables(*names: str) -> str:
    """The beginning of a DuckDB query over these domain tables; its own expressions follow after a comma."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
