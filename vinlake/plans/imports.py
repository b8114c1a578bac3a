"""Pages and documents in: markup fields, archives, dates from ids, registry records, JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.functions import dates, meta, text
from vinlake.functions import phrases as X
from vinlake.functions import states as T
from vinlake.operators import ingest as I
from vinlake.operators.registry_records import record_events
from vinlake.plans.registry import query
from vinlake.session import scratch
from vinlake.sources import domain as D
from vinlake.sources import readers as R
from vinlake.sources.writers import append, export_rows, nested, write_csv, write_json


@query(
    r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{00A0}]+', ' ', 'g')), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*?\slang\s*=\s*["'']([^"'']*)["'']', 1), '') AS lang,
 len(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']')) AS n_links, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS n_paragraphs FROM pages"""
)
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say in their markup."""
    fields = R.page_fields(F.col("html"))
    return D.table(spark, sf_dir, "pages").select("page_id", *(fields[n].alias(n) for n in ("title", "lang", "n_links", "n_paragraphs")))


@query(
    f"""SELECT url, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\s\\x{{00A0}}]+', ' ', 'g')), '') AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']')) AS BIGINT) AS n_links,
 regexp_matches(html[1:4000], '(?i)^\\s*(?:<!doctype\\s+html|<html)|<(?:head|body)[\\s>]') AS is_page FROM pages"""
)
def adapted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the parser that is registered under a name."""
    return R.ADAPTERS["generic"](D.table(spark, sf_dir, "pages")).select("url", "title", "n_links", "is_page")


def _with_state(pages: DataFrame) -> DataFrame:
    """Pages with their own title and links in script states, as shops write them: an assignment, data of a framework, and one that is cut off."""
    fields, html = R.page_fields(F.col("html")), F.col("html")
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    note = F.concat(F.lit('x = {"a": [1}; } ] \\ " '), F.coalesce(fields["title"], F.lit("")))
    state = F.to_json(F.struct(note.alias("note"), F.struct(fields["title"].alias("title"), F.transform(links, lambda x: F.struct(x.alias("href"))).alias("links")).alias("page")))
    data = F.to_json(F.struct(F.struct(F.struct(F.col("page_id").alias("id"), F.array(F.col("page_id") % 7, F.size(links)).alias("counts")).alias("pageProps")).alias("props")))
    pictures = F.concat(*(F.concat(F.lit(f'"https:\\/\\/cdn.example.com\\/lot\\/{size}\\/'), F.col("page_id").cast("string"), F.lit(f'-{k}.jpg?w=1",')) for size in ("640x480", "1024x768") for k in (1, 2)))
    scripts = F.concat(
        F.lit("<script>window.__STATE__ = "), state, F.lit('; window.later={"ok":true};</script><script id="__NEXT_DATA__" type="application/json">'), data, F.lit('</script><script>var cut = {"a": [1, 2;</script><script>var shots = ['), pictures,
        F.lit('"https://cdn.example.com/logo.png"];</script></head>'),
    )
    at = F.locate("</head>", html)
    return pages.withColumn("html", F.concat(F.substr(html, F.lit(1), at - 1), scripts, F.substr(html, at + 7)))


_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{00A0}]+', ' ', 'g')), '')"
_LINKS = r"""regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)"""


@query(
    f"""WITH p AS (SELECT page_id, {_TITLE} AS title, {_LINKS} AS links FROM pages WHERE contains(html, '</head>'))
SELECT page_id, '__STATE__' AS name, title, links[1] AS first_link, NULL AS id, NULL AS n_links FROM p UNION ALL SELECT page_id, 'later', NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT page_id, '__NEXT_DATA__', NULL, NULL, page_id, CAST(len(links) AS BIGINT) FROM p UNION ALL SELECT page_id, 'shots', NULL, NULL, NULL, NULL FROM p"""
)
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages hold in the state objects of their scripts: titles, links and numbers, with brackets and quotes inside strings."""
    found = T.page_states(_with_state(D.table(spark, sf_dir, "pages")), "html", "page_id")
    at = lambda path, kind="string": T.at_path(F.col("state"), path, kind)
    return found.select("page_id", "name", at("page.title").alias("title"), at("page.links.0.href").alias("first_link"), at("props.pageProps.id", "bigint").alias("id"), at("props.pageProps.counts.1", "bigint").alias("n_links"))


@query("""SELECT page_id, CAST(k - 1 AS INT) AS pos, 'https://cdn.example.com/lot/1024x768/' || page_id || '-' || k || '.jpg' AS url FROM pages, (SELECT unnest([1, 2]) AS k) WHERE contains(html, '</head>')""")
def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that pages name in scripts, each shot once in its largest size, logos left out."""
    return T.harvested_pictures(_with_state(D.table(spark, sf_dir, "pages")), "html", "page_id")


@query(
    r"""WITH r AS (SELECT page_id, page_id % 10 AS provider_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS source_id, CASE WHEN page_id % 3 = 0 THEN html ELSE CAST(json_object('id', page_id % 7) AS VARCHAR) END AS raw FROM pages)
SELECT DISTINCT provider_id, source_id, sha256(raw) AS content_hash FROM r WHERE NOT starts_with(raw, '<') AND page_id >= 50 AND NOT EXISTS (SELECT 1 FROM r k WHERE k.page_id < 50 AND k.provider_id = r.provider_id AND k.source_id = r.source_id AND k.raw = r.raw)"""
)
def raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that an archive takes: no web pages, and nothing that it holds."""
    p, k = D.table(spark, sf_dir, "pages"), F.col("page_id")
    raw = F.when(k % 3 == 0, F.col("html")).otherwise(F.to_json(F.struct((k % 7).alias("id"))))
    rows = p.select("page_id", (k % 10).alias("provider_id"), F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1).alias("source_id"), raw.alias("raw"))
    old = rows.filter("page_id < 50").withColumn("content_hash", F.sha2(F.col("raw").cast("binary"), 256))
    return I.archived(rows.filter("page_id >= 50"), old, ["page_id"]).select("provider_id", "source_id", "content_hash")


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate ELSE o_orderdate + INTERVAL 3 HOUR END AS listed_at FROM orders"""
)
def dates_from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that source ids carry: item codes, goods ids and object ids."""
    o, k, d = D.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    seconds = F.unix_seconds(d.cast("timestamp")) + 3 * 3600
    sid = (
        F.when(k % 3 == 0, F.concat(F.lit("CI"), F.date_format(d, "yyyyMMdd"), F.lit("0005"))).when(k % 3 == 1, F.concat(F.lit("PT"), F.date_format(d, "yyMMdd"), F.lit("-0010399")))
        .otherwise(F.concat(F.lpad(F.lower(F.hex(seconds)), 8, "0"), F.lit("abcdefabcdef0123")))
    )
    s = F.col("sid")
    return o.select(k.alias("id"), sid.alias("sid")).select("id", F.coalesce(dates.from_item_code(s), dates.from_goods_id(s), dates.from_object_id(s)).alias("listed_at"))


@query(
    """SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, bool_or(regexp_matches(text, '[0-9]')) AS has_digit FROM conversations GROUP BY conv_id"""
)
def ticket_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with their last author (J17): the latest child by max_by, without a loop over threads."""
    c = D.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"), F.bool_or(F.col("text").rlike("[0-9]")).alias("has_digit"))


@query(
    r"""SELECT doc_id, regexp_matches(trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}]+', ' ', 'g')), '(?i)salvage[ds]?(?:$|[^A-Za-z0-9_])|(?:^|[^A-Za-z0-9_])slvg(?:$|[^A-Za-z0-9_])|(?:^|[^A-Za-z0-9_])junk(?:$|[^A-Za-z0-9_])|non[- ]?repairable|certificate of destruction|(?:^|[^A-Za-z0-9_])cod(?:$|[^A-Za-z0-9_])|(?:^|[^A-Za-z0-9_])rebuilt(?:$|[^A-Za-z0-9_])|parts only|(?:^|[^A-Za-z0-9_])total[_\s-]*loss(?:$|[^A-Za-z0-9_])|전손|총손실|총손') AS salvage,
 regexp_matches(coalesce(text, ''), '[가-힣]') AS hangul FROM documents"""
)
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of free text: losses and scripts."""
    from vinlake.functions.labels import has_hangul

    return D.table(spark, sf_dir, "documents").select("doc_id", text.salvage(F.col("text")).alias("salvage"), F.coalesce(has_hangul(F.col("text")), F.lit(False)).alias("hangul"))


@query(
    """SELECT l_partkey AS vehicle_id, count(*) AS events, count(*) FILTER (l_linenumber % 2 = 0) AS owners, count(*) FILTER (l_linenumber % 2 = 1) AS accidents, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * 10 END) AS DOUBLE) AS cost FROM lineitem GROUP BY 1"""
)
def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from nested registry records: owner changes numbered by date, accidents with their costs."""
    x = D.table(spark, sf_dir, "lineitem")
    raw = x.groupBy(F.col("l_partkey").alias("vehicle_id")).agg(F.to_json(F.struct(
        F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.date_format("l_shipdate", "yyyyMMdd").alias("date"), F.col("l_suppkey").cast("string").alias("carNo")))).alias("carInfoChanges"),
        F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), (F.col("l_quantity") * 10).alias("insuranceBenefit"), F.lit("1").alias("type")))).alias("accidents"),
    )).alias("raw"))
    out = record_events(raw)
    benefit = meta.number(meta.parsed(F.col("metadata")), "insuranceBenefit")
    return out.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "owner_change").alias("owners"), F.count_if(F.col("event_type") == "accident").alias("accidents"), F.sum(benefit).alias("cost"))


@query(
    f"""{D.with_tables("listings")} SELECT o_orderkey AS order_id, count(l_orderkey) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with an array of their children, as an export nests them, and read back (K7, A10)."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    x = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    out = nested(o, {"lines": x}, ["order_id"])
    return out.select("order_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("lines"), F.aggregate("lines", F.lit(0.0), lambda a, r: a + r["quantity"]).alias("quantity"))


@query(
    f"""{D.with_tables("listings", "vehicles")}, k AS (SELECT provider_id, source_id, max(vin) AS vin, max(price_amount) AS price_amount, max(mileage) AS mileage, max(seen_at) AS last_seen_at FROM listings JOIN vehicles ON vehicle_id = id GROUP BY 1, 2),
h AS (SELECT provider_id, source_id, price_amount AS price, mileage, seen_at AS modified_at FROM listings)
SELECT h.* FROM h JOIN k USING (provider_id, source_id) WHERE length(vin) = 17 AND k.mileage > 1 AND h.price IS NOT DISTINCT FROM k.price_amount AND h.mileage IS NOT DISTINCT FROM k.mileage AND h.modified_at <= k.last_seen_at + INTERVAL 2 SECOND"""
)
def unchanged_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered references that need no fetch."""
    x = D.listings(spark, sf_dir)
    v = D.vehicles(spark, sf_dir).select(F.col("id").alias("vehicle_id"), "vin")
    known = x.join(v, "vehicle_id").groupBy("provider_id", "source_id").agg(*(F.max(c).alias(c) for c in ("vin", "price_amount", "mileage")), F.max("seen_at").alias("last_seen_at"))
    hints = x.select("provider_id", "source_id", F.col("price_amount").alias("price"), "mileage", F.col("seen_at").alias("modified_at"))
    return I.unchanged(known, hints)


@query(
    f"""{D.with_tables("vehicles", "listings", "providers")} SELECT upper(vin) AS vin, internal_name AS provider, source_id, CAST(price_amount AS DOUBLE) AS price, price_currency AS currency, lower(trim(listing_status)) = 'active' AS active
FROM listings JOIN vehicles ON vehicle_id = vehicles.id JOIN providers ON provider_id = providers.id"""
)
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written as CSV parts with their byte order mark, and imported again."""
    x = D.listings(spark, sf_dir).withColumns({"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")})
    path = scratch(spark)
    write_csv(export_rows(x, D.vehicles(spark, sf_dir), D.providers(spark, sf_dir)), path)
    return R.read_listings_csv(spark, path).select("vin", "provider", "source_id", "price", "currency", "active")


@query(
    f"""{D.with_tables("vehicles", "listings")} SELECT upper(vin) AS vin, make, CAST(provider_id AS VARCHAR) AS provider, source_id, CAST(price_amount AS DOUBLE) AS price FROM listings JOIN vehicles ON vehicle_id = id"""
)
def imported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles with nested listings written as lines of JSON, and imported flat."""
    x = D.listings(spark, sf_dir).select("vehicle_id", F.col("provider_id").cast("string").alias("provider"), "source_id", F.col("price_amount").cast("double").alias("price"))
    v = D.vehicles(spark, sf_dir).select(F.col("id").alias("vehicle_id"), "vin", "make")
    cars = nested(v.join(x.select("vehicle_id").distinct(), "vehicle_id", "left_semi"), {"listings": x}, ["vehicle_id"])
    path = scratch(spark)
    write_json(cars.select(F.array(F.struct("vin", "make", "listings")).alias("vehicles")), path)
    return R.read_listings_json(spark, path, lines=True).select("vin", "make", "provider", "source_id", "price")


@query("""SELECT o_orderkey AS order_id, 'vehicle-export' AS format, 2 AS version, '2024-01-31' AS "exportedAt", o_orderstatus AS status FROM orders""")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested export in its envelope, read again (K7)."""
    path = scratch(spark)
    write_json(D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), path, "vehicle-export", 2, "2024-01-31")
    rows = spark.read.schema("format string, version int, exportedAt string, listing struct<id:bigint,status:string>").json(path)
    return rows.select(F.col("listing.id").alias("order_id"), "format", "version", "exportedAt", F.col("listing.status").alias("status"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 1""")
def appended_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to folders by a column, read as one table (K9)."""
    o, path = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), scratch(spark)
    append(o.filter("id % 2 = 0"), path, "status")
    append(o.filter("id % 2 = 1"), path, "status")
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@query(
    """SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supplier, l_partkey AS part, l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1990-01-01' AS sold,
 CASE WHEN l_linestatus = 'F' AND l_suppkey % 3 > 0 THEN l_shipdate WHEN l_partkey % 2 = 0 THEN o_orderdate WHEN l_partkey % 5 = 0 THEN l_shipdate + INTERVAL 1 DAY ELSE TIMESTAMP '2024-01-31' END AS observed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def observation_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an observation happened, from what its listing says of it."""
    x, o = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "orders")
    rows = x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    when = lambda c, t: F.when(c, t)
    at = I.observed_at(
        when(F.col("l_linestatus") == "F", F.lit("Sold")), when(F.col("l_suppkey") % 3 > 0, F.col("l_shipdate")), when(F.col("l_partkey") % 2 == 0, F.col("o_orderdate")),
        when(F.col("l_partkey") % 5 == 0, F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")), F.lit(D.AS_OF).cast("timestamp_ntz"),
    )
    return rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), ((F.col("l_linestatus") == "F") & (F.year("l_shipdate") >= 1990)).alias("sold"), at.alias("observed_at"))


@query(
    """SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, CASE l_partkey % 6 WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN l_quantity >= 1 WHEN 4 THEN l_suppkey % 3 > 0 ELSE false END AS salvage FROM lineitem"""
)
def loss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that speak of losses, and those that count none of them."""
    x, k = D.table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    q, n = F.col("l_quantity").cast("long").cast("string"), (F.col("l_suppkey") % 3).cast("string")
    said = (
        F.when(k % 6 == 0, F.concat(F.lit("Salvage title, lot "), q)).when(k % 6 == 1, "Total loss from flooding: 0").when(k % 6 == 2, F.concat(F.lit("Vehicle total loss count: 0, owners: "), q))
        .when(k % 6 == 3, F.concat(F.lit("rebuilt after "), q)).when(k % 6 == 4, F.concat(F.lit("Vehicle total_loss count: "), n)).otherwise("Vehicle total-loss record: 0")
    )
    return x.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), k.alias("part"), text.salvage(said).alias("salvage"))


#: A dictionary with phrases that begin alike, overlap and hold one another.
WORDS = {"the": "le", "the of": "le du", "the of the": "le du le", "of the in": "du le dans", "in": "dans", "in the": "dans le", "and": "et", "th": "z", "und": "and", "und der": "and the", "der die": "the she", "de la": "of the", "de": "of", "la que": "which", "que": "that", "ción": "tion", "y": "&", "é": "e"}
_SORTED = sorted(WORDS, key=len, reverse=True)


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s){"|".join(_SORTED)}|.') AS pieces, MAP {{{", ".join(f"'{k}': '{v}'" for k, v in WORDS.items())}}} AS d FROM documents)
SELECT doc_id, CAST(len([x FOR x IN pieces IF d[x] IS NOT NULL]) AS BIGINT) AS n_phrases, md5(array_to_string([coalesce(d[x], x) FOR x IN pieces], '')) AS text_md5 FROM w"""
)
def phrases_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a dictionary replaced in whole texts, the longest at each place (locale dictionaries)."""
    d, t = X.Phrases(WORDS), F.coalesce("text", F.lit(""))
    pieces = D.table(spark, sf_dir, "documents").select("doc_id", d.pieces(t).alias("p"))  # cut up once for both
    return pieces.select("doc_id", d.counted(F.col("p")).cast("long").alias("n_phrases"), F.md5(F.encode(d.joined(F.col("p")), "UTF-8")).alias("text_md5"))


@query(
    f"""{D.with_tables("events")} SELECT vehicle_id, order_id, line, CASE m_source WHEN 'registry' THEN 'Register' ELSE 'Auction house' END AS source, CASE WHEN m_field IS NOT NULL THEN '1st registration' END AS field, coalesce(m_currency, '') AS currency,
 CASE WHEN starts_with(description, 'Accident at') THEN 'Crash @' || substr(description, 12) WHEN description = 'Owner change' THEN 'Change of owner' WHEN starts_with(description, 'New car ') THEN 'New auto ' || substr(description, 9) ELSE description END AS description FROM vehicle_events"""
)
def phrases_in_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases replaced in descriptions and in the string values of metadata, whose field names stay (locale dictionaries)."""
    d = X.Phrases({"registry": "Register", "auction": "Auction house", "first": "1st", "firstRegistration": "1st registration", "Accident": "Crash", "Accident at": "Crash @", "Owner change": "Change of owner", "car": "auto", "source": "src", "field": "fld"})
    e = D.events(spark, sf_dir).withColumns({"metadata": d.replaced_in_json(F.col("metadata")), "description": d.replaced(F.col("description"))})
    at = lambda n: F.get_json_object("metadata", f"$.{n}")
    return e.select("vehicle_id", "order_id", "line", at("source").alias("source"), at("field").alias("field"), F.coalesce(at("currency"), F.lit("")).alias("currency"), "description")
