"""Vehicle search: filters, facets, pages, exports and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinlake.functions import geo, labels
from vinlake.functions.money import SAMPLE_RATES, effective_usd
from vinlake.operators.filters import Search, by_dimension, listing_conditions, missing, vehicle_conditions
from vinlake.operators.projections import kept
from vinlake.operators.windows import first_per_key
from vinlake.plans.registry import query
from vinlake.sources import domain as D
from vinlake.sources.writers import export_rows

SEARCH = Search(fuel="Diesel", year_from=1995, year_to=2020, usd_from=5, usd_to=90)
#: Facet: its column, the dimension of the search that it leaves out, and how many values it shows.
FACETS = {"fuel": 200, "make": 200, "model": 200, "country": 80, "year": 80, "transmission": 80}


#: Dimensions whose conditions compare labels, which no scan can skip by.
LABELS = ("model", "fuel", "country")


def found(vehicles: DataFrame, listings: DataFrame, s: Search, omit: str | None = None) -> DataFrame:
    """Vehicles that fit (F1-F8): listing conditions are a semi-join, so a vehicle counts once however many listings it has."""
    dims, on = {d: c for d, c in by_dimension(s).items() if d != omit}, listing_conditions(s)
    out = reduce(DataFrame.filter, (c for d, c in dims.items() if d not in LABELS), vehicles)
    # Where labels are computed from the key, Spark would infer their filter for all that is joined by that key, and find labels for each of those rows.
    labelled = [c for d, c in dims.items() if d in LABELS]
    out = kept(out, reduce(Column.__and__, labelled)) if labelled else out
    return out if on is None else out.join(listings.filter(on).select(F.col("vehicle_id").alias("id")), "id", "left_semi")


def facets(vehicles: DataFrame, listings: DataFrame, s: Search) -> DataFrame:
    """(facet, value, n): for each facet its most frequent values among vehicles that fit all conditions but those of its own dimension.

    One scan and one semi-join serve all facets: each vehicle is tested once by each dimension, gives a row for each facet that it counts for, and those are summed up
    within tasks before the shuffle. Canonical labels are counted, so nothing has to be merged afterwards."""
    on, dims = listing_conditions(s), by_dimension(s)
    rows = vehicles if on is None else vehicles.join(listings.filter(on).select(F.col("vehicle_id").alias("id")), "id", "left_semi")
    fuel = F.coalesce(labels.fuel(F.col("fuel_type")), F.trim("fuel_type"))
    values = {"fuel": fuel, "make": F.col("make"), "model": labels.model(F.col("model")), "country": geo.country(F.col("country")), "year": F.col("year").cast("string"), "transmission": F.col("trim")}
    rows = rows.select(*(c.alias(f"ok_{d}") for d, c in dims.items()), *(values[name].alias(name) for name in FACETS))

    def entry(name: str) -> Column:
        fits = reduce(Column.__and__, (F.coalesce(F.col(f"ok_{d}"), F.lit(False)) for d in dims if d != name), F.lit(True))
        return F.when(fits & F.col(name).isNotNull(), F.struct(F.lit(name).alias("facet"), F.col(name).alias("value")))

    each = rows.select(F.explode(F.filter(F.array(*map(entry, FACETS)), lambda x: x.isNotNull())).alias("x")).select("x.facet", "x.value")
    counts = each.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    most = F.element_at(F.create_map(*(F.lit(x) for pair in FACETS.items() for x in pair)), F.col("facet"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


_FUELS = "CASE fuel_type " + " ".join(f"WHEN '{raw}' THEN '{out}'" for raw, out in zip(D.FUELS, ("Diesel", "Gasoline", "Plug-in Hybrid", "Diesel", "Diesel", "Hybrid", "Electric", "LPG", "Other"))) + " END"
_MODELS = "CASE model WHEN '5er' THEN '5 Series' WHEN '3-series' THEN '3 Series' WHEN 'c class' THEN 'C-Class' WHEN 'GLC-class' THEN 'GLC-Class' ELSE model END"
_PLACES = "CASE country " + " ".join(f"WHEN '{raw}' THEN '{out}'" for raw, out in zip(D.PLACES, ("South Korea", "United States", "United States", "Germany", "Norway", "South Korea", "Atlantis"))) + " END"
_PRICED = "EXISTS (SELECT 1 FROM listings l WHERE l.vehicle_id = v.id AND l.price_currency = 'USD' AND l.price_amount BETWEEN 5 AND 90)"


def _facet_sql(name: str) -> str:
    value = {"fuel": f"coalesce({_FUELS}, trim(fuel_type))", "model": _MODELS, "country": _PLACES, "transmission": "trim"}.get(name, f"CAST({name} AS VARCHAR)")
    parts = [_PRICED] + ([] if name == "fuel" else [f"{_FUELS} = 'Diesel'"]) + ([] if name == "year" else ["year BETWEEN 1995 AND 2020"])
    return f"(SELECT '{name}' AS facet, {value} AS value, count(*) AS n FROM vehicles v WHERE {' AND '.join(parts)} GROUP BY 2 ORDER BY n DESC, value LIMIT {FACETS[name]})"


@query(f"""{D.with_tables("vehicles", "listings")} {" UNION ALL ".join(map(_facet_sql, FACETS))}""")
def vehicle_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six facets of one search, each without its own condition."""
    return facets(D.vehicles(spark, sf_dir), D.listings(spark, sf_dir), SEARCH)


@query(
    f"""{D.with_tables("vehicles", "listings", "providers")}, p AS (SELECT vehicle_id, min(CASE WHEN price_currency = 'USD' THEN CAST(price_amount AS DOUBLE) END) AS min_usd, count(*) AS n_listings, string_agg(DISTINCT internal_name, ', ' ORDER BY internal_name) AS providers
 FROM listings JOIN providers ON provider_id = providers.id AND enabled GROUP BY vehicle_id)
SELECT id, vin, year, min_usd, n_listings, providers FROM vehicles v JOIN p ON id = vehicle_id WHERE {_FUELS} = 'Diesel' AND year BETWEEN 1995 AND 2020 AND {_PRICED} ORDER BY min_usd NULLS LAST, id LIMIT 20 OFFSET 20"""
)
def vehicle_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search by lowest price (O1, O2, O5, J1, J9, A9): enabled providers only (F16), nulls last, ties by id."""
    v, x = D.vehicles(spark, sf_dir), D.listings(spark, sf_dir)
    enabled = D.providers(spark, sf_dir).filter("enabled").select(F.col("id").alias("provider_id"), "internal_name")
    usd = effective_usd(F.lit(None).cast("double"), F.col("price_amount"), F.col("price_currency"))
    per = x.join(enabled, "provider_id").groupBy(F.col("vehicle_id").alias("id")).agg(F.min(usd).alias("min_usd"), F.count(F.lit(1)).alias("n_listings"), F.array_join(F.array_sort(F.collect_set("internal_name")), ", ").alias("providers"))
    page = found(v, x, SEARCH).join(per, "id").orderBy(F.col("min_usd").asc_nulls_last(), "id").offset(20).limit(20)
    return page.select("id", "vin", "year", "min_usd", "n_listings", "providers")


@query(
    f"""{D.with_tables("vehicles")} SELECT id, vin, make FROM vehicles WHERE lower(vin) LIKE '%c1%' OR lower(make) LIKE '%c1%' OR lower(model) LIKE '%c1%'"""
)
def vehicle_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text in identifier, make or model (F2)."""
    return D.vehicles(spark, sf_dir).filter(vehicle_conditions(Search(search=" C1 "))).select("id", "vin", "make")


_RATES = "CASE price_currency " + " ".join(f"WHEN '{c}' THEN {r!r}" for c, r in SAMPLE_RATES.items()) + " END"
_CENTS = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_USD = f"CASE price_currency WHEN 'USD' THEN CAST(price_amount AS DOUBLE) WHEN 'EUR' THEN price_amount / {SAMPLE_RATES['EUR']!r}::DOUBLE ELSE price_amount / ({_RATES})::DOUBLE END"
_EUR = f"CASE price_currency WHEN 'EUR' THEN CAST(price_amount AS DOUBLE) ELSE ({_USD}) * {SAMPLE_RATES['EUR']!r}::DOUBLE END"
_KM = "CASE WHEN mileage > 1 AND mileage <= 2000000 THEN CAST(floor(CASE mileage_unit WHEN 'mi' THEN mileage / 0.621371::DOUBLE ELSE mileage END + 0.5) AS BIGINT) END"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id, source_id ORDER BY seen_at DESC, mileage DESC, price_amount DESC NULLS LAST, price_currency, mileage_unit, listing_status, vehicle_id) AS n, min(seen_at) OVER (PARTITION BY provider_id, source_id) AS first_seen FROM listings) WHERE n = 1)"


def latest_first() -> list:
    """Newest snapshot first, ties by every column."""
    return [F.col("seen_at").desc(), F.col("mileage").desc(), F.col("price_amount").desc_nulls_last(), "price_currency", "mileage_unit", "listing_status", "vehicle_id"]


@query(
    f"""{D.with_tables("vehicles", "listings", "providers")}, {_LATEST}
SELECT vin, make, model, year, trim, fuel_type AS fuel, {_KM} AS mileage_km, CAST(floor(({_KM}) * 0.621371::DOUBLE + 0.5) AS BIGINT) AS mileage_miles, price_amount AS price, price_currency AS currency, {_CENTS(_USD)} AS price_usd, {_CENTS(_EUR)} AS price_eur,
 location, vehicles.country AS country, CASE WHEN lower(trim(listing_status)) = 'active' THEN 'yes' ELSE 'no' END AS active, source_id, internal_name AS provider, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(seen_at, '%Y-%m-%d') AS last_seen
FROM latest JOIN vehicles ON vehicle_id = vehicles.id JOIN providers ON provider_id = providers.id"""
)
def listing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a CSV export: the latest snapshot of each listing with dollars, euros and miles."""
    x = D.listings(spark, sf_dir).withColumn("first_seen_at", F.min("seen_at").over(Window.partitionBy("provider_id", "source_id")))
    x = first_per_key(x, ["provider_id", "source_id"], latest_first()).withColumn("last_seen_at", F.col("seen_at"))
    out = export_rows(x, D.vehicles(spark, sf_dir), D.providers(spark, sf_dir))
    return out.drop("transmission", "drivetrain", "engine", "color", "body_type", "listing_url")


@query(
    f"""{D.with_tables("vehicles", "listings")} SELECT (SELECT count(*) FROM vehicles) AS vehicles, (SELECT count(DISTINCT vehicle_id) FROM listings) AS listed, (SELECT count(*) FROM listings) AS listings, (SELECT count(*) FROM supplier) AS providers,
 (SELECT count(*) FROM vehicles WHERE fuel_type = 'unknown') AS unknown_fuel, (SELECT CAST(floor(count(DISTINCT vehicle_id) / (SELECT count(*) FROM vehicles) * 100 + 0.5) AS BIGINT) FROM listings) AS coverage"""
)
def dashboard_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of several tables in one row (A17, A1, A2): each table gives one row, and rows of one meet by a union and a sum, without a join."""
    from vinlake.functions.numbers import share_percent

    names = ("vehicles", "listed", "listings", "providers", "unknown_fuel")
    v = D.vehicles(spark, sf_dir).agg(F.count(F.lit(1)).alias("vehicles"), F.count_if(F.col("fuel_type") == "unknown").alias("unknown_fuel"))
    x = D.listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("vehicle_id").alias("listed"))
    p = D.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("providers"))
    one = v.unionByName(x, allowMissingColumns=True).unionByName(p, allowMissingColumns=True).agg(*(F.sum(n).alias(n) for n in names))
    return one.withColumn("coverage", share_percent(F.col("listed"), F.col("vehicles")))


@query(
    f"""{D.with_tables("vehicles", "listings", "providers")}, o AS (SELECT internal_name AS provider, vehicle_id, count(*) AS n, bool_or(listing_status = 'Sold') AS sold FROM listings JOIN providers ON provider_id = providers.id GROUP BY ALL)
SELECT provider, count(*) AS vehicles, CAST(sum(n) AS BIGINT) AS listings, count(*) FILTER (sold) AS with_sale, round(avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS repeat_ratio, max(n) AS most FROM o GROUP BY provider HAVING count(*) >= 3"""
)
def provider_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of aggregation: by provider and vehicle, then by provider."""
    x, p = D.listings(spark, sf_dir), D.providers(spark, sf_dir)
    per = x.groupBy("provider_id", "vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("listing_status") == "Sold").alias("sold"))
    out = per.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("vehicles"), F.sum("n").alias("listings"), F.count_if("sold").alias("with_sale"), F.round(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), 3).alias("repeat_ratio"), F.max("n").alias("most")
    ).filter("vehicles >= 3")
    return out.join(p.select(F.col("id").alias("provider_id"), F.col("internal_name").alias("provider")), "provider_id").select("provider", "vehicles", "listings", "with_sale", "repeat_ratio", "most")


@query(
    f"""{D.with_tables("vehicles")} SELECT id, list_filter([CASE WHEN make IS NULL OR trim(make) = '' THEN 'make' END, CASE WHEN {_FUELS} IS NULL THEN 'fuel' END, CASE WHEN {_PLACES} = 'Atlantis' THEN 'known_country' END], lambda x: x IS NOT NULL) AS missing_fields
FROM vehicles WHERE {_FUELS} IS NULL OR {_PLACES} = 'Atlantis'"""
)
def low_confidence_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles with fields that no rule could fill, and which."""
    rows = D.vehicles(spark, sf_dir).select("id", "make", labels.fuel(F.col("fuel_type")).alias("fuel"), F.nullif(geo.country(F.col("country")), F.lit("Atlantis")).alias("known_country"))
    return rows.select("id", missing("make", "fuel", "known_country").alias("missing_fields")).filter(F.size("missing_fields") > 0)
