"""Labels over catalogues, joins of several kinds, unions, samples and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.functions import geo, labels
from vinlake.operators import joins as J
from vinlake.operators import sets as S
from vinlake.operators.filters import LiveSearch, live_conditions
from vinlake.plans.registry import query
from vinlake.plans.search import _FUELS, _MODELS, _PLACES
from vinlake.sources import blocks as B
from vinlake.sources import domain as D
from vinlake.sources import readers as R


@query(f"""{D.with_tables("vehicles")} SELECT id, {_FUELS} AS fuel, {_MODELS} AS model, {_PLACES} AS country, lower(replace({_PLACES}, ' ', '_')) AS slug FROM vehicles""")
def vehicle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fuel, model and country of every vehicle."""
    return D.vehicles(spark, sf_dir).select("id", labels.fuel(F.col("fuel_type")).alias("fuel"), labels.model(F.col("model")).alias("model"), geo.country(F.col("country")).alias("country"), geo.slug(F.col("country")).alias("slug"))


@query(
    f"""{D.with_tables("vehicles")}, t AS (SELECT id, year || ' ' || make || ' ' || model || ' clean title' AS title, year, make, model FROM vehicles) SELECT id, year, make, split_part(model, ' ', 1) AS model FROM t"""
)
def title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, make and model read back from titles."""
    v = D.vehicles(spark, sf_dir).withColumn("title", F.concat_ws(" ", F.col("year").cast("string"), "make", "model", F.lit("clean title")))
    year, make, model = labels.title_parts(F.col("title"), [f"Brand#{i}" for i in range(1, 26)])
    return v.select("id", year.alias("year"), make.alias("make"), model.alias("model"))


@query(
    f"""{D.with_tables("listings")} SELECT p.s_suppkey AS id, l.source_id, l.price_amount, l.seen_at FROM supplier p LEFT JOIN LATERAL (SELECT * FROM listings l WHERE l.provider_id = p.s_suppkey ORDER BY seen_at DESC, source_id DESC, price_amount DESC NULLS LAST, vehicle_id LIMIT 1) l ON true"""
)
def latest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider with its latest listing."""
    p = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    x = D.listings(spark, sf_dir).withColumn("id", F.col("provider_id"))
    order = [F.col("seen_at").desc(), F.col("source_id").desc(), F.col("price_amount").desc_nulls_last(), "vehicle_id"]
    return J.with_latest(p, x, "id", order, {"source_id": "source_id", "price_amount": "price_amount", "seen_at": "seen_at"})


@query(
    """SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey OR o_orderkey = c_custkey GROUP BY 1"""
)
def either_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that either of two keys ties to a parent (J10): two equi-joins instead of a nested loop."""
    c, o = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), D.table(spark, sf_dir, "orders")
    return J.either_key_count(c, o, "o_orderkey", [("id", "o_custkey"), ("id", "o_orderkey")], "n")


@query(
    """SELECT o_orderkey AS order_id, o_custkey AS client_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)"""
)
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti- and semi-joins."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id"))
    lines = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    rich = D.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("client_id"))
    return S.gate(S.difference(o, lines, ["order_id"]), rich, keys=["client_id"])


@query(
    f"""{D.with_tables("vehicles", "listings")}, l AS (SELECT 'a' AS source, vehicle_id || '-a' AS listing_id, vehicle_id, price_amount, price_currency, mileage FROM listings WHERE provider_id % 2 = 0 UNION ALL SELECT 'b', vehicle_id || '-b', vehicle_id, price_amount, price_currency, NULL FROM listings WHERE provider_id % 2 = 1),
u AS (SELECT l.*, year, CASE price_currency WHEN 'USD' THEN CAST(price_amount AS DOUBLE) WHEN 'EUR' THEN price_amount / 0.92::DOUBLE ELSE price_amount / 1400.0::DOUBLE END AS p FROM l JOIN vehicles ON vehicle_id = id)
SELECT source, listing_id, floor(p * 100 + 0.5) / 100 AS usd, mileage FROM u WHERE coalesce(year, 0) >= 2000 AND floor(p * 100 + 0.5) / 100 >= 1 ORDER BY usd NULLS LAST, listing_id, mileage NULLS FIRST, source, vehicle_id LIMIT 50"""
)
def live_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds with different columns in one (U1): filtered again after the union (F19), sorted with nulls last (O7), one page."""
    from vinlake.functions.money import with_usd_eur

    x, v = D.listings(spark, sf_dir), D.vehicles(spark, sf_dir).select(F.col("id").alias("vehicle_id"), "year")
    base = ["vehicle_id", "price_amount", "price_currency"]
    feeds = {name: x.filter(F.col("provider_id") % 2 == k).select(F.concat_ws("-", F.col("vehicle_id").cast("string"), F.lit(name)).alias("listing_id"), *base, *more) for k, name, more in ((0, "a", ["mileage"]), (1, "b", []))}
    rows = with_usd_eur(S.tagged_union(feeds).join(v, "vehicle_id"), "price_amount", "price_currency")
    rows = rows.filter(live_conditions(LiveSearch(year_from=2000, usd_from=1), rows.columns))
    return rows.orderBy(F.col("usd").asc_nulls_last(), "listing_id", F.col("mileage").asc_nulls_first(), "source", "vehicle_id").limit(50).select("source", "listing_id", "usd", "mileage")


@query(
    """SELECT DISTINCT x FROM (SELECT c_mktsegment AS x FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT o_orderstatus FROM orders)"""
)
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of several columns."""
    return S.distinct_union(*(D.table(spark, sf_dir, t).select(F.col(c).alias("x")) for t, c in (("customer", "c_mktsegment"), ("part", "p_type"), ("orders", "o_orderstatus"))))


@query(
    """SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.v ELSE t.v END AS v FROM (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) t FULL JOIN (SELECT o_orderkey AS id, nullif(o_orderpriority, '5-LOW') AS v FROM orders WHERE o_orderkey % 2 = 0) s ON t.id = s.id"""
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert as a snapshot (K2)."""
    o, k = D.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    target = o.filter(k % 3 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("v"))
    source = o.filter(k % 2 == 0).select(k.alias("id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("v"))
    return J.upserted(target, source, ["id"], ["v"])


@query(
    """SELECT o_orderkey AS id, CASE WHEN c_acctbal > 5000 THEN c_acctbal ELSE o_totalprice END AS amount FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)"""
)
def update_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update from a join, and a delete by a list of keys, as snapshots."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client"), F.col("o_totalprice").alias("amount"))
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"), F.col("c_acctbal").alias("amount"))
    doomed = D.table(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select("l_orderkey").distinct()
    done = J.updated_from(o, c, ["client"], ["amount"], when=F.col("s_amount") > 5000)
    return J.purged({"orders": done}, doomed, {"orders": "id"})["orders"].select("id", "amount")


@query(
    """WITH k AS (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keep FROM customer) SELECT keep AS client, count(o_orderkey) AS orders FROM k JOIN orders ON o_custkey = c_custkey GROUP BY keep"""
)
def merged_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged into the smallest id, their children pointed to it."""
    c = D.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("client"))
    mapping = J.merge_duplicates(c, ["c_nationkey", "c_mktsegment"])
    return J.repointed(o, mapping, "client").join(mapping.select(F.col("keep").alias("client")).distinct(), "client", "left_semi").groupBy("client").agg(F.count("o_orderkey").alias("orders"))


@query(
    """WITH t AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey + 1000000 AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT 'missing' AS kind, s.id AS source_id, NULL AS target_id FROM s WHERE name NOT IN (SELECT name FROM t) UNION ALL SELECT 'mapped', s.id, t.id FROM s JOIN t USING (name)"""
)
def database_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy lacks, and how ids of both sides map."""
    c, k = D.table(spark, sf_dir, "customer"), F.col("c_custkey")
    missing, mapping = J.synced(c.filter(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("name")), c.filter(k % 2 == 0).select((k + 1000000).alias("id"), F.col("c_name").alias("name")), "name")
    return missing.select(F.lit("missing").alias("kind"), F.col("id").alias("source_id"), F.lit(None).cast("long").alias("target_id")).unionByName(mapping.select(F.lit("mapped").alias("kind"), "source_id", "target_id"))


@query(
    f"""WITH f AS (SELECT min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS total FROM lineitem), d AS (SELECT *, (high - low + {B.BLOCKS}) // {B.BLOCKS} AS width FROM f),
x AS (SELECT (l_orderkey - low) // width AS block, l_discount >= 0.09 AS sold FROM lineitem, d), c AS (SELECT (high - low + width) // width AS blocks, total FROM d),
n AS (SELECT CAST(count(*) AS DOUBLE) AS drawn FROM (SELECT unnest(range(0, (SELECT blocks FROM c))) AS block) WHERE (block * 2654435761) % 4294967296 < 0.1 * 4294967296),
p AS (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (sold) AS DOUBLE) AS y FROM x WHERE (block * 2654435761) % 4294967296 < 0.1 * 4294967296 GROUP BY block), s AS (SELECT sum(m) AS m, sum(y) AS y, sum(y * y) - 2 * (sum(y) / sum(m)) * sum(y * m) + (sum(y) / sum(m)) * (sum(y) / sum(m)) * sum(m * m) AS v FROM p)
SELECT CAST(floor(total * (y / m) + 0.5) AS BIGINT) AS estimate, round({B.DEVIATIONS} * sqrt((1 - drawn / blocks) * drawn * v / (drawn - 1)) / m * total, 3) AS bound, CAST(m AS BIGINT) AS n_sampled, total FROM s, c, n"""
)
def sample_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold listings estimated from a tenth of the table's blocks, with a bound; the table's size and range come from its footers."""
    rows, design = B.block_sample(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", 0.1)
    return B.estimated(rows, F.col("l_discount") >= 0.09, design).withColumn("bound", F.round("bound", 3))


@query("""SELECT 'orders' AS name, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem UNION ALL SELECT 'documents', count(*), min(doc_id), max(doc_id) FROM documents""")
def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and key ranges of tables, from Parquet footers alone."""
    parts = [B.footer_facts(spark, f"{sf_dir}/{t}.parquet", k).select(F.lit(t).alias("name"), "n", F.col(f"low_{k}").alias("low"), F.col(f"high_{k}").alias("high")) for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("documents", "doc_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 40""")
def keyset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch after a key."""
    return R.batch_after(D.table(spark, sf_dir, "orders"), "o_orderkey", 5000, 40).select("o_orderkey", "o_custkey")


@query(
    f"""{D.with_tables("events")}, b AS (SELECT provider_id, string_agg(DISTINCT description, ' | ' ORDER BY description) AS blob FROM vehicle_events GROUP BY 1) SELECT provider_id, CASE WHEN blob LIKE '%Accident%' AND blob LIKE '%Final price%' THEN 'auction' WHEN blob LIKE '%Inspection%' THEN 'inspection' ELSE 'unknown' END AS inferred FROM b"""
)
def provider_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's kind from the words of its events (E38, A9): each keyword is looked for by row, and only flags are gathered."""
    d = F.col("description")
    has = lambda p: F.bool_or(d.rlike(f"(?i){p}"))
    e = D.events(spark, sf_dir).groupBy("provider_id").agg(has("accident").alias("a"), has("final price").alias("f"), has("inspection").alias("i"))
    return e.select("provider_id", F.when(F.col("a") & F.col("f"), "auction").when(F.col("i"), "inspection").otherwise("unknown").alias("inferred"))


_DRIVE = ("полный привод", "передний", "AWD (4x4)", "Цена 100 полный", "Rear-wheel", "unknown", "some very long text about the drive", "магия", "Chain")


@query(
    f"""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'AWD' WHEN 1 THEN 'FWD' WHEN 2 THEN 'AWD' WHEN 4 THEN 'RWD' WHEN 8 THEN 'Chain' END AS drive, CASE WHEN p_size % 5 > 0 THEN (p_size % 5) || '.0 L' END AS engine FROM part"""
)
def clean_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification values without debris, foreign scripts and stand-ins."""
    from vinlake.functions import specs

    p, k = D.table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = F.get(F.array(*map(F.lit, _DRIVE)), (k % len(_DRIVE)).cast("int"))
    return p.select(k.alias("id"), specs.english(raw, specs.DRIVES).alias("drive"), specs.displacement(F.concat((F.col("p_size") % 5).cast("string"), F.lit(".0 L"))).alias("engine"))


@query(
    f"""{D.with_tables("vehicles")} SELECT id, CASE WHEN id % 2 = 0 THEN 'F1' || id % 10 WHEN id % 3 = 0 THEN 'W2' || 10 + id % 7 END AS chassis, CASE WHEN id % 2 = 0 THEN '528i ' || trim WHEN id % 3 = 0 THEN 'E220d' END AS after_code, trim AS remainder FROM vehicles"""
)
def title_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation and trim as titles state them."""
    from vinlake.functions import specs

    k = F.col("id")
    coded = (
        F.when(k % 2 == 0, F.concat(F.lit("[BMW]  5 Series (f1"), (k % 10).cast("string"), F.lit(") 528i "), "trim")).when(k % 3 == 0, F.concat(F.lit("[Mercedes] E-Class w2"), (10 + k % 7).cast("string"), F.lit(" - E220d"))).otherwise(F.lit("plain title"))
    )
    plain = F.concat_ws(" ", F.col("year").cast("string"), F.upper("make"), "model", "trim")
    return D.vehicles(spark, sf_dir).select("id", specs.chassis_code(coded).alias("chassis"), specs.trim_after_code(coded).alias("after_code"), specs.trim_remainder(plain, F.col("year"), F.col("make"), F.col("model")).alias("remainder"))


@query(
    """SELECT l_orderkey || '-' || l_linenumber AS source_id, count(*) AS n, CAST(sum(CASE WHEN l_quantity > 1 THEN l_quantity * CASE l_linenumber % 4 WHEN 0 THEN 1 ELSE 100 END END) AS BIGINT) AS km FROM lineitem GROUP BY 1"""
)
def mileage_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from the listing itself, metadata, a payload's tree or the title."""
    from vinlake.functions.walks import salvaged_mileage

    q, way = F.col("l_quantity"), F.col("l_linenumber") % 4
    digits = (q * 100).cast("long").cast("string")
    metadata = F.when(way == 1, F.to_json(F.struct(F.struct((q * 100).cast("long").alias("value")).alias("odometer"))))
    payload = F.when(way == 2, F.concat(F.lit('{"a": [{"b": {"Mileage": "'), digits, F.lit(' km"}}]}')))
    title = F.when(way == 3, F.concat(F.lit("nice car, "), digits, F.lit("km")))
    km = salvaged_mileage(F.when(way == 0, q), metadata, payload, title, F.lit(None).cast("string"))
    rows = D.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_id"), F.when(q > 1, km).alias("km"))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("km").cast("long").alias("km"))


@query(
    f"""{D.with_tables("events")} SELECT vehicle_id, order_id, line, m_date AS day, m_currency AS currency, CAST(NULL AS VARCHAR) AS source FROM vehicle_events"""
)
def public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the public sees them: metadata without what tells their source."""
    from vinlake.functions import meta
    from vinlake.operators.projections import public_events as shown

    m = F.col("m")
    return shown(D.events(spark, sf_dir)).withColumn("m", meta.parsed(F.col("metadata"))).select("vehicle_id", "order_id", "line", meta.text(m, "date").alias("day"), meta.text(m, "currency").alias("currency"), meta.text(m, "source").alias("source"))


@query(
    """SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'thrifty' WHEN 'SMALL' THEN 'little' ELSE p_type END AS trim FROM part"""
)
def translated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a dictionary of words (J14): broadcast only when its size is counted."""
    from vinlake.functions.specs import translated

    words = spark.createDataFrame([("economy", "thrifty"), (" Small", "little"), ("car", "auto")], "word string, meaning string")
    return translated(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("trim")), "trim", words)


@query(
    f"""{D.with_tables("vehicles", "listings", "providers")} SELECT internal_name AS value, count(DISTINCT vehicle_id) AS n FROM listings JOIN providers ON provider_id = providers.id AND enabled JOIN vehicles ON vehicle_id = vehicles.id WHERE year >= 2010 GROUP BY 1 ORDER BY n DESC, value LIMIT 80"""
)
def provider_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles by provider (A16): listings of enabled providers, each vehicle once a provider."""
    x = D.listings(spark, sf_dir).select("vehicle_id", "provider_id").distinct()
    p = D.providers(spark, sf_dir).filter("enabled").select(F.col("id").alias("provider_id"), F.col("internal_name").alias("value"))
    v = D.vehicles(spark, sf_dir).filter("year >= 2010").select(F.col("id").alias("vehicle_id"))
    n = x.join(v, "vehicle_id", "left_semi").groupBy("provider_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(p, "provider_id").orderBy(F.col("n").desc(), "value").limit(80).select("value", "n")


@query(
    f"""{D.with_tables("vehicles", "listings")} SELECT make, id, vehicle_id IS NOT NULL AS listed FROM (SELECT v.make, v.id, l.vehicle_id, row_number() OVER (PARTITION BY make ORDER BY coalesce(n, 0) DESC, id) AS r FROM vehicles v LEFT JOIN (SELECT vehicle_id, count(*) AS n FROM listings GROUP BY 1) l ON l.vehicle_id = v.id) WHERE r <= 4"""
)
def top_vehicles_by_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vehicles of each make, the most listed first."""
    from vinlake.operators.windows import cap_per_key

    n = D.listings(spark, sf_dir).groupBy(F.col("vehicle_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = D.vehicles(spark, sf_dir).select("make", "id").join(n, "id", "left")
    return cap_per_key(rows, ["make"], [F.coalesce("n", F.lit(0)).desc(), "id"], 4).select("make", "id", F.col("n").isNotNull().alias("listed"))


_ENGINE = "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN (id % 6 + 1) || '.5 L' WHEN 2 THEN CAST(800 + id % 3000 AS VARCHAR) ELSE '1,' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ' cc' END"


@query(
    f"""{D.with_tables("vehicles", "listings")}, e AS (SELECT *, {_ENGINE} AS engine FROM vehicles),
c AS (SELECT *, CASE id % 4 WHEN 1 THEN (id % 6 + 1) * 1000 + 500 WHEN 2 THEN 800 + id % 3000 WHEN 3 THEN 1000 + id % 1000 END AS cc FROM e),
u AS (SELECT c.id, c.make, c.cc, l.mileage, c.model, floor(CASE price_currency WHEN 'USD' THEN CAST(price_amount AS DOUBLE) WHEN 'EUR' THEN price_amount / 0.92::DOUBLE ELSE price_amount / 1400.0::DOUBLE END * 100 + 0.5) / 100 AS usd, c.year, c.trim FROM listings l JOIN c ON l.vehicle_id = c.id)
SELECT id, count(*) AS n, max(usd) AS usd FROM u WHERE cc BETWEEN 1200 AND 3500 AND coalesce(year, 0) >= 1995 AND coalesce(year, 9999) <= 2020 AND mileage <= 40000 AND usd <= 60 AND contains(lower(concat_ws(' ', make, model, trim)), 'brand#1') AND contains(lower(trim), 'small') AND mileage >= 10000 AND usd >= 1 GROUP BY id"""
)
def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that the combined live filter lets through, with ranges of year, mileage, displacement and dollars."""
    from vinlake.functions.money import with_usd_eur

    k = F.col("id")
    engine = F.when(k % 4 == 1, F.concat((k % 6 + 1).cast("string"), F.lit(".5 L"))).when(k % 4 == 2, (800 + k % 3000).cast("string")).when(k % 4 == 3, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" cc")))
    v = D.vehicles(spark, sf_dir).withColumn("engine_displacement", engine)
    rows = with_usd_eur(D.listings(spark, sf_dir).join(v, F.col("vehicle_id") == k), "price_amount", "price_currency")
    want = LiveSearch(year_from=1995, year_to=2020, mileage_from=10_000, mileage_to=40_000, engine_from=1200, engine_to=3500, usd_from=1, usd_to=60, make="Brand#1", texts={"trim": "SMALL"})
    return rows.filter(live_conditions(want, rows.columns)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("usd").alias("usd"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 10 AND 400 OR o_orderkey BETWEEN 1000 AND 1100 OR o_orderkey BETWEEN 9000 AND 12000""")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of some ranges of a key."""
    return R.id_windows(D.table(spark, sf_dir, "orders"), "o_orderkey", ((10, 400), (1000, 1100), (9000, 12_000))).select("o_orderkey", "o_custkey")


@query("""SELECT p_partkey AS id, r.name FROM part JOIN (VALUES (1, 'one'), (2, 'two'), (7, 'seven')) AS r(size, name) ON p_size = r.size""")
def literal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table beside rows that a query itself spells out as JSON."""
    names = R.literal_rows(spark, '[{"size": 1, "name": "one"}, {"size": 2, "name": "two"}, {"size": 7, "name": "seven"}]', "size:int,name:string")
    return D.table(spark, sf_dir, "part").join(names, F.col("p_size") == F.col("size")).select(F.col("p_partkey").alias("id"), "name")


@query("""SELECT DISTINCT ON (l_partkey) CAST(l_partkey AS VARCHAR) AS source_id, l_orderkey AS page, l_linenumber AS pos FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber""")
def newest_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of several pages, each once at its first place."""
    x = D.table(spark, sf_dir, "lineitem")
    return R.newest_refs(x.select(F.col("l_partkey").cast("string").alias("source_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos")))
