"""Per-vehicle histories, for all vehicles at once: odometer, accidents, owners, sales, title, body condition, specs, timeline and the report.

Each builder shuffles once on the vehicle and reads metadata with Column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vinlake.functions import dates, meta, text
from vinlake.functions import mileage as M
from vinlake.functions.once import bound
from vinlake.operators.ingest import FIRST_REGISTRATION, first_registration_score, is_first_registration, status_key
from vinlake.operators.projections import kept
from vinlake.operators.windows import first_per_key, run_window, with_runs

# Which kind of reading wins when several state the same day and distance.
KIND_RANK = {"inspection": 6, "owner": 5, "accident": 4, "sale": 3, "listing": 2, "salvage": 1, "other": 0}
#: The source whose records weigh more, unless another is named.
TRUSTED = "registry"
SPEC_FIELDS = ("condition", "secondary_damage", "primary_damage", "loss_type", "airbags", "keys", "seats", "doors", "color", "engine", "location")


#: Every field of metadata that a rule of this module asks for.
FIELDS = (
    "mileageUnit", "unit", "odometerType", "odometer_type", "source", "mileageKm", "mileageMiles", "mileage", "odometer", "odometerValue", "odometer_value", "km", "miles",
    "date", "issueDate", "validityStartDate", "validityEndDate", "firstRegistrationDate", "soldDate", "datePrecision", "registered",
    "partCost", "laborCost", "paintingCost", "repairTotal", "currency", "type", "rawType", "value", "damage", "plate", "carNo", "info", "field", "kind",
    "priceAmount", "amount", "finalPrice", "buyNowPrice", "auctionPrice", "openingBid", "priceCurrency", "priceUsd", "priceEur", "provider", "sourceListingId",
    "title", "damageClass", "salvage", "totalLossCnt", "floodTotalLossCnt", "state", "status",
    "sequence", "diagnosisNo", "bodyCondition", "allClear", "panels", "comments", "recordNo", "sticky",
)


def with_meta(events: DataFrame) -> DataFrame:
    """Events with their metadata parsed once, as the struct _m of FIELDS; as they are if they have it."""
    return events if "_m" in events.columns else events.withColumn("_m", meta.fields(F.col("metadata"), FIELDS))


def with_km(events: DataFrame) -> DataFrame:
    """Events (with _m) with _km: the reading that each states (E18): kilometres, miles, a number in the unit given or inferred, then the description. Each candidate is
    a column before it is tested, so none is computed twice, and descriptions are searched only where metadata has no reading. Events that have _km stay as they are."""
    if "_km" in events.columns:
        return events
    m = F.col("_m")
    unit = F.coalesce(meta.text(m, "mileageUnit", "unit", "odometerType", "odometer_type"), F.when(meta.text(m, "source").rlike("(?i)auction"), "mi").otherwise("km"))
    rows = events.withColumns({"_k": meta.loose_number(m, "mileageKm"), "_i": meta.loose_number(m, "mileageMiles"), "_x": meta.loose_number(m, "mileage", "odometer", "odometerValue", "odometer_value", "km"), "_y": meta.loose_number(m, "miles"), "_u": unit})
    ok = lambda c: F.when(M.usable(F.col(c)), F.col(c))
    stated = F.coalesce(M.to_km(ok("_k"), F.lit("km")), M.to_km(ok("_i"), F.lit("mi")), M.to_km(ok("_x"), F.col("_u")), M.to_km(ok("_y"), F.lit("mi")))
    rows = rows.withColumn("_stated", stated).withColumn("_said", F.when(F.col("_stated").isNull(), M.in_text(F.col("description"))))
    return rows.withColumn("_km", F.coalesce("_stated", M.to_km(F.col("_said"), F.col("_u")))).drop("_k", "_i", "_x", "_y", "_u", "_stated", "_said")


#: Fields that state the day on which an odometer was read.
READ_DAYS = ("date", "issueDate", "validityStartDate", "firstRegistrationDate", "soldDate")


def reading_day(said: Mapping[str, Column], occurred: Column) -> Column:
    """The day on which an odometer was read (E18): stated days first; an event's own day unless it is the first registration's. said: the text of each of READ_DAYS."""
    day = lambda n: F.when(said[n].isNotNull(), bound(said[n], dates.day))
    own, first = dates.day_of(occurred), day("firstRegistrationDate")
    return F.coalesce(*(day(n) for n in ("date", "issueDate", "validityStartDate")), F.when(first.isNull() | (own != first), own), day("soldDate"))


def event_readings(events: DataFrame) -> DataFrame:
    """(vehicle_id, day, km, kind, source, of_event) of events; km is null for those that state no reading. They are not filtered here: a filter would be pushed below the columns
    that it tests and compute them twice."""
    m, kind = F.col("_m"), F.lower("event_type")
    source = F.col("_source")
    what = (
        F.when(kind == "owner_change", "owner").when(kind.isin("accident", "flood_damage"), "accident").when((kind == "inspection") | source.rlike("(?i)inspection|diagnosis"), "inspection")
        .when(kind == "sale", "sale").when(kind == "title_status", "salvage").otherwise("other")
    )
    rows = with_km(with_meta(events)).withColumn("_source", F.coalesce(meta.text(m, "source"), F.col("event_type"), F.lit("event")))
    # Texts of days are columns before their forms are asked for: written out at each use they make one method that the JVM doesn't compile.
    named = {n: f"_d{i}" for i, n in enumerate(READ_DAYS)}
    rows = rows.withColumns({c: meta.text(m, n) for n, c in named.items()})
    day = reading_day({n: F.col(c) for n, c in named.items()}, F.col("occurred_at"))
    return rows.select("vehicle_id", day.alias("day"), F.col("_km").alias("km"), what.alias("kind"), source.alias("source"), F.lit(True).alias("of_event"))


def observation_readings(observations: DataFrame, day: Column, source: Column) -> DataFrame:
    return observations.select("vehicle_id", day.alias("day"), M.to_km(F.when(M.usable(F.col("mileage")), F.col("mileage")), F.col("mileage_unit")).alias("km"), F.lit("listing").alias("kind"), source.alias("source"), F.lit(False).alias("of_event"))


def mileage_history(*readings: DataFrame) -> DataFrame:
    """(vehicle_id, day, km, miles, kind, sources, latest, of_event) from readings (vehicle_id, day, km, kind, source, of_event).

    One row per vehicle, day and distance, of the highest kind, with its sources in order. Of a run of listing rows with one distance the first and last stay and carry
    the run's sources. The vehicle's last row is the latest. of_event: an event states this day and distance."""
    runs = _ends(readings).withColumn("_all", F.collect_set("sources").over(Window.partitionBy("vehicle_id", "run"))).filter("_end")
    sources = F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(F.sort_array(F.array_distinct(F.flatten("_all"))))
    return runs.select("vehicle_id", "day", "km", M.to_miles(F.col("km")).alias("miles"), "kind", sources.alias("sources"), "latest", "of_event")


def _ends(readings: Sequence[DataFrame]) -> DataFrame:
    """Readings by vehicle, day and distance in order, with their runs: _end where one begins or ends; every: all the vehicle's sources."""
    rows = readings[0]
    for more in readings[1:]:
        rows = rows.unionByName(more)
    rows = kept(rows, F.col("day").isNotNull() & M.usable(F.col("km")))
    by_rank = sorted(KIND_RANK, key=KIND_RANK.get)
    rank = F.array_position(F.array(*map(F.lit, by_rank)), F.col("kind"))
    # One shuffle and one sort: readings of a day and distance, which few share, and then the vehicle's are windows over the same order.
    g = Window.partitionBy("vehicle_id", "day", "km")
    rows = rows.repartition("vehicle_id").withColumn("_rank", F.nullif(rank, F.lit(0)).cast("int")).select(
        "vehicle_id", "day", "km", F.max("_rank").over(g).alias("_rank"), F.sort_array(F.collect_set("source").over(g)).alias("sources"), F.bool_or("of_event").over(g).alias("of_event"), F.row_number().over(g.orderBy("vehicle_id")).alias("_n"),
        F.collect_set("source").over(Window.partitionBy("vehicle_id")).alias("every"),
    ).filter("_n = 1").drop("_n")
    rows = rows.withColumn("kind", F.get(F.array(*map(F.lit, by_rank)), F.col("_rank") - 1)).drop("_rank")
    order = ["day", "km"]
    w = run_window(["vehicle_id"], order)
    runs = with_runs(rows, ["vehicle_id"], order, (F.col("kind") == "listing") & (F.lag("kind").over(w) == "listing") & (F.lag("km").over(w) == F.col("km")))
    before, after = F.lag("run").over(w), F.lead("run").over(w)
    return runs.select("*", (F.coalesce(before != F.col("run"), F.lit(True)) | F.coalesce(after != F.col("run"), F.lit(True))).alias("_end"), after.isNull().alias("latest"))


def mileage_sums(*readings: DataFrame) -> DataFrame:
    """(vehicle_id, readings, latest_km, sources, uncovered): the sums of mileage_history without its rows: how many there are, the last one's distance, all sources in order,
    and how many no event covers. Each run's ends carry all its sources, so the vehicle's are those of all its readings."""
    whole = Window.partitionBy("vehicle_id")
    of_ends = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(whole)
    rows = _ends(readings).select("vehicle_id", "km", "every", "latest", of_ends(F.col("_end")).alias("readings"), of_ends(F.col("_end") & ~F.col("of_event")).alias("uncovered"))
    return rows.filter("latest").select("vehicle_id", "readings", F.col("km").alias("latest_km"), F.sort_array("every").alias("sources"), "uncovered")


def is_accident(kind: Column) -> Column:
    """Registry accidents; lot specifications with a damage field are none."""
    return F.coalesce(F.lower(kind).isin("accident", "flood_damage", "total_loss"), F.lit(False))


def accidents(events: DataFrame) -> DataFrame:
    """(vehicle_id, day, type, category, damage, repair_total, currency, source, km): a row for each accident that says anything."""
    m, kind = F.col("_m"), F.lower("event_type")
    part, labor, paint = (meta.number(m, n) for n in ("partCost", "laborCost", "paintingCost"))
    total = F.when(F.coalesce(part, labor, paint).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in (part, labor, paint)), F.lit(0.0)))
    what = F.when(kind == "flood_damage", "flood_damage").otherwise("accident")
    category = F.when(kind == "flood_damage", "flood").when(kind == "total_loss", "total_loss").otherwise(meta.text(m, "type", "rawType"))
    rows = with_km(with_meta(events.filter(is_accident(F.col("event_type"))))).select(
        "vehicle_id", F.coalesce(meta.text(m, "date"), dates.day_of(F.col("occurred_at")), F.lit("Unknown date")).alias("day"), what.alias("type"), category.alias("category"), meta.text(m, "value", "damage").alias("damage"),
        F.coalesce(meta.number(m, "repairTotal"), total).alias("repair_total"), meta.text(m, "currency").alias("currency"), meta.text(m, "source").alias("source"), F.col("_km").alias("km"),
        F.col("description").alias("_d"),
    )
    return rows.filter(F.coalesce("damage", "category", F.nullif(F.trim("_d"), F.lit(""))).isNotNull() | (F.col("repair_total") > 0)).drop("_d")


def owner_changes(events: DataFrame, ties: Sequence[Column | str], trusted: str = TRUSTED) -> DataFrame:
    """(vehicle_id, day, sequence, info, plate, km, source): one change of owner a day (E20). A row's fields come from the day's best row, gaps from the next best;
    a plate may come from any event of that day. trusted: the source whose rows score three more."""
    events, m = with_meta(events), F.col("_m")
    plate = meta.text(m, "plate", "carNo")
    plates = events.select("vehicle_id", dates.day_of(F.col("occurred_at")).alias("_pd"), plate.alias("_p"), F.struct("occurred_at", *ties).alias("_o")).filter("_p IS NOT NULL")
    plates = plates.groupBy("vehicle_id", "_pd").agg(F.max_by("_p", "_o").alias("_day_plate"))
    info = F.nullif(F.coalesce(meta.text(m, "info"), F.trim("description")), F.lit(""))
    generic = info.rlike(r"(?i)^(?:title transfer.*|ownership|owner change|owner change.*recorded on.*)$")
    rows = events.filter("event_type = 'owner_change'").withColumn("_pd", dates.day_of(F.col("occurred_at"))).join(plates, ["vehicle_id", "_pd"], "left")
    rows = rows.select(
        "vehicle_id", F.coalesce(meta.text(m, "date"), F.col("_pd"), F.lit("Unknown date")).alias("date"), F.when(~generic, info).alias("info"), F.coalesce(plate, F.col("_day_plate")).alias("plate"),
        meta.number(m, "mileageKm", "mileage", "odometer", "km").alias("km"), F.coalesce(meta.text(m, "source"), F.lit("registry")).alias("source"), F.struct("occurred_at", *ties).alias("_o"),
    )
    score = F.when(F.col("plate").isNotNull(), 4).otherwise(0) + F.when(F.col("info").isNotNull(), 2).otherwise(0) + F.when(F.col("km").isNotNull(), 1).otherwise(0) + F.when(F.col("source") == trusted, 3).otherwise(0)
    rows = rows.withColumns({"day": F.substring("date", 1, 10), "_s": score})
    w = Window.partitionBy("vehicle_id", "day").orderBy(F.col("_s").desc(), "_o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.row_number().over(Window.partitionBy("vehicle_id", "day").orderBy(F.col("_s").desc(), "_o"))
    one = rows.select("vehicle_id", "day", *(F.first(c, ignorenulls=True).over(w).alias(c) for c in ("info", "plate", "km", "source")), n.alias("_n")).filter("_n = 1").drop("_n")
    return one.withColumn("sequence", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("day")))


#: Auction houses that sell in dollars. Labels of mirror sites, which give way to an auction house's name, and of sources that aren't shown are parameters.
DOLLAR_HOUSES = ("iaa", "copart")
MIRRORS, HIDDEN = ("mirror",), ("aggregator",)
_SALE = "struct<day:string,amount:double,currency:string,usd:double,eur:double,registered:string,provider:string,source_id:string,source:string,later:string>"


def sale_events(events: DataFrame, ties: Sequence[Column | str], houses: Sequence[str] = DOLLAR_HOUSES, mirrors: Sequence[str] = MIRRORS, hidden: Sequence[str] = HIDDEN, won: str | None = None) -> DataFrame:
    """(vehicle_id, day, amount, currency, usd, eur, registered, provider, source_id, source, later, _o): the sales that events state, one for each day and amount.

    Of several events with one day and amount each field is the first that says anything in the order (occurred_at, *ties); registered is the first event's, later that of
    any. An amount without a currency that is stated as a
    final, buy-now or auction price below 500,000 is in dollars, and so is the price of a dollar house. won: sources (a pattern) whose other prices are in won."""
    events, m = with_meta(events.filter("event_type = 'sale'")), F.col("_m")
    stated = F.regexp_extract("description", r"(?i)(?:Final price|Buy now|Sold for)\s*:?\s*\$?\s*([\d,]+(?:\.\d+)?)", 1)
    named = F.when(meta.text(m, "field").isin("final_price", "buy_now"), meta.number(m, "value"))
    amount = F.coalesce(meta.number(m, "priceAmount", "amount", "finalPrice", "buyNowPrice", "auctionPrice"), named, F.replace(stated, F.lit(","), F.lit("")).try_cast("double"))
    source, said = meta.text(m, "source"), meta.text(m, "provider", "source")
    provider = F.when(~F.lower(said).isin(*(x.lower() for x in (*mirrors, *hidden))), said)
    bid = meta.number(m, "finalPrice", "buyNowPrice", "auctionPrice", "openingBid")
    rows = events.select(
        "vehicle_id", F.coalesce(meta.text(m, "soldDate"), dates.day_of(F.col("occurred_at"))).alias("day"), amount.alias("amount"), meta.text(m, "priceCurrency", "currency").alias("_c"), (bid.isNotNull()).alias("_bid"),
        meta.number(m, "priceUsd").alias("_usd"), meta.number(m, "priceEur").alias("eur"), meta.text(m, "registered").alias("registered"), provider.alias("provider"), meta.text(m, "sourceListingId").alias("source_id"),
        source.alias("_s"), F.struct("occurred_at", *ties).alias("_o"),
    )
    rows = kept(rows, F.col("day").isNotNull())
    dollars = F.col("_c").isNull() & F.col("_bid") & (F.col("amount") > 0) & (F.col("amount") < 500_000)
    house = F.coalesce(F.col("provider").isin(*houses), F.lit(False)) | F.coalesce(F.col("_s").isin(*houses), F.lit(False))
    rows = rows.withColumns({
        "currency": F.coalesce("_c", F.when(dollars, "USD"), _sale_currency(F.col("provider"), F.col("_s"), won)), "usd": F.coalesce("_usd", F.when(dollars | house, F.col("amount"))),
    })
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c)
    one = rows.groupBy("vehicle_id", "day", "amount").agg(
        *map(pick, ("currency", "usd", "eur", "provider", "source_id")), F.min_by("registered", "_o").alias("registered"), F.min_by("registered", F.when(F.col("registered").isNotNull(), F.col("_o"))).alias("later"),
        F.min("_o").alias("_o"), F.min_by("_s", "_o").alias("_s"), F.count(F.lit(1)).alias("_n"),
    )
    # A sale that one event states carries that event's source; merged ones are "sale_event".
    return one.withColumn("source", F.coalesce(F.when(F.col("_n") == 1, F.col("_s")), F.lit("sale_event"))).drop("_s", "_n")


def _sale_currency(provider: Column, source: Column, won: str | None) -> Column:
    blob = F.lower(F.concat_ws(" ", F.coalesce(provider, F.lit("")), F.coalesce(source, F.lit(""))))
    return F.when(blob.rlike(won), "KRW").otherwise("USD") if won else F.lit("USD")


def auction_sales(
    events: DataFrame, observations: DataFrame, ties: Sequence[Column | str], seen_ties: Sequence[Column | str] = (), houses: Sequence[str] = DOLLAR_HOUSES, mirrors: Sequence[str] = MIRRORS, hidden: Sequence[str] = HIDDEN, won: str | None = None
) -> DataFrame:
    """(vehicle_id, day, amount, currency, usd, eur, registered, provider, source_id, source, from_event): the sales of every vehicle.

    Sales that events state come first, in order. Then each sold observation (vehicle_id, day, amount, currency, usd, eur, provider, source_id and seen_ties, in the order
    of day and seen_ties) meets the list so far: the first sale that covers it (J13: the same source id, the same amount, or the same day where either amount is missing)
    takes what it lacks from the observation, and the observation's provider unless that is a mirror's label; without one the observation is the next sale of the list,
    and can itself cover later ones. registered: the event's own, else the vehicle's most precise first registration.

    A vehicle's list depends on all before, so it is a fold over one array a vehicle. What the array holds is small: sales are merged before, and of observations that repeat
    the one before them in the order the first alone goes in, as the others would be covered by the same sale and add nothing."""
    sales = sale_events(events, ties, houses, mirrors, hidden, won)
    order = Window.partitionBy("vehicle_id").orderBy("day", *seen_ties, *_SEEN)
    known = [c for c in observations.columns if c in _SEEN]
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    seen = observations.select("vehicle_id", blank(F.col("day")).alias("day"), *(F.col(c) if c in known else F.lit(None).cast(kind).alias(c) for c, kind in _SEEN.items()), *seen_ties).filter("day IS NOT NULL")
    seen = seen.withColumns({"source_id": blank(F.col("source_id")), "provider": blank(F.col("provider")), "_at": F.row_number().over(order), "_before": F.lag(F.struct("day", *_SEEN)).over(order)})
    seen = seen.filter(~F.struct("day", *_SEEN).eqNullSafe(F.col("_before")))
    firsts = registered_labels(events)
    as_sale = F.struct(*(F.col(c) for c in ("day", "amount", "currency", "usd", "eur", "registered", "provider", "source_id", "source", "later"))).cast(_SALE)
    of_events = sales.select("vehicle_id", F.struct("_o", as_sale.alias("r")).alias("e"), F.lit(None).cast(f"struct<_at:int,r:{_SALE}>").alias("o"))
    currency = F.coalesce(F.col("currency"), _sale_currency(F.col("provider"), F.lit(None), won))
    as_seen = F.struct(F.col("day"), F.col("amount"), currency.alias("currency"), F.col("usd"), F.col("eur"), F.lit(None).cast("string").alias("registered"), F.col("provider"), F.col("source_id"), F.lit("observation").alias("source"), F.lit(None).cast("string").alias("later")).cast(_SALE)
    of_seen = seen.select("vehicle_id", F.lit(None).cast(of_events.schema["e"].dataType).alias("e"), F.struct("_at", as_seen.alias("r")).alias("o"))
    lists = of_events.unionByName(of_seen).groupBy("vehicle_id").agg(F.array_sort(F.collect_list("e")).alias("e"), F.array_sort(F.collect_list("o")).alias("o"))
    lists = lists.join(firsts, "vehicle_id", "left").withColumn("sales", F.aggregate("o", F.transform("e", lambda x: x["r"]), lambda rows, o: _with_observation(rows, o["r"], mirrors)))
    out = lists.select("vehicle_id", "first", F.explode("sales").alias("r")).select("vehicle_id", "first", "r.*")
    return out.withColumns({"registered": F.coalesce("registered", "first", "later"), "from_event": F.col("source") != "observation"}).drop("first", "later")


#: Columns of an observation beside vehicle_id and day; those that are not given are null.
_SEEN = {"amount": "double", "currency": "string", "usd": "double", "eur": "double", "provider": "string", "source_id": "string"}


def _with_observation(rows: Column, o: Column, mirrors: Sequence[str]) -> Column:
    """The list of sales after an observation: one step of the fold."""

    def covers(r: Column) -> Column:
        same_day = (r["day"] == o["day"]) & (r["amount"].isNull() | o["amount"].isNull())
        return F.coalesce(r["source_id"] == o["source_id"], F.lit(False)) | F.coalesce(r["amount"] == o["amount"], F.lit(False)) | same_day

    def filled(r: Column) -> Column:
        mirror = lambda c: F.lower(c).isin(*(x.lower() for x in mirrors))
        provider = F.coalesce(F.when(~mirror(o["provider"]), o["provider"]), F.when(~mirror(r["provider"]), r["provider"]), o["provider"], r["provider"])
        first = [F.coalesce(r[c], o[c]).alias(c) for c in ("amount", "currency", "usd", "eur")]
        return F.struct(r["day"].alias("day"), *first, r["registered"].alias("registered"), provider.alias("provider"), F.coalesce(r["source_id"], o["source_id"]).alias("source_id"), r["source"].alias("source"), r["later"].alias("later"))

    def put(at: Column) -> Column:
        return F.when(at == 0, F.concat(rows, F.array(o))).otherwise(F.transform(rows, lambda r, i: F.when(i == at - 1, filled(r)).otherwise(r)))

    # The place is bound by an array of one, or it would be sought again for each sale.
    return F.get(F.transform(F.array(F.coalesce(F.array_position(F.transform(rows, covers), True), F.lit(0))), lambda at: put(at)), F.lit(0))


def registered_labels(events: DataFrame) -> DataFrame:
    """(vehicle_id, first): the most precise first registration of each vehicle, as people would write it: a value as it is (a day without its time), else the event's own day,
    cut to the year or month if that is all that is known (E21, E11)."""
    # What can be none is left out by its text, before any JSON is parsed.
    may = F.contains("metadata", F.lit("first")) | F.col("description").rlike(FIRST_REGISTRATION)
    events, m = with_meta(kept(events, F.coalesce(may, F.contains("metadata", F.lit("first")), F.lit(False)))), F.col("_m")
    said = F.regexp_extract("description", r"(?i)First registration:\s*(.+)$", 1)
    first = F.coalesce(is_first_registration(F.col("event_type"), F.col("description"), m) | (said != ""), F.lit(False))
    value, day, unit = meta.text(m, "value"), dates.day_of(F.col("occurred_at")), F.lower(meta.text(m, "datePrecision"))
    source = F.coalesce(meta.text(m, "source"), F.lit(""))
    of_year = (unit == "year") | (source == "productionYear") | (F.trim(said).rlike(r"^\d{4}$") & F.endswith(day, F.lit("-01-01")))
    label = F.coalesce(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(value, 1, 10)).otherwise(value), F.when(F.coalesce(of_year, F.lit(False)), F.substring(day, 1, 4)).when(unit == "month", F.substring(day, 1, 7)).otherwise(day), F.nullif(F.substring(F.trim(said), 1, 10), F.lit("")))
    score = first_registration_score(F.substring(F.coalesce(value, F.trim(said), F.lit("")), 1, 10), source)
    # Of the same score the earliest, then the smaller label.
    rows = events.select("vehicle_id", label.alias("l"), score.alias("s"), F.col("occurred_at").alias("at"), first.alias("first"))
    return kept(rows, F.col("first") & F.col("l").isNotNull()).groupBy("vehicle_id").agg(F.min(F.struct(-F.col("s"), F.col("at").isNull(), "at", "l"))["l"].alias("first"))


# Fields of title rows, of flags, and of counts whose zero is no loss.
TITLE_FIELDS = ("title", "vehicle_title", "detailed_title", "title_code", "title_type", "title_status", "title_name", "doc_type")
FLAG_FIELDS = ("totalloss", "salvagerecord", "salvage", "vehiclecategory", "damage", "damageclass")
COUNT_FIELDS = ("total_loss_count", "flood_loss_count", "total_loss", "totalloss")
#: Metadata without any of these fields' names (or an escape, which can spell one) holds no signal.
SIGNAL_FIELDS = r"field|value|salvage|damageClass|\\"


def salvage_records(events: DataFrame, order: Sequence[Column | str], always: str | None = None) -> DataFrame:
    """(vehicle_id, salvage, title, detailed_title, state, status, day, source): one row for each vehicle with title or loss events that say anything.

    salvage: any event flags it; the other fields are the first in the order that say anything. Counts of zero losses are no signal, but a count is looked for only in
    fields of counts, so a salvage title that also states zero losses stays, as does a flood's own count. always: sources (a pattern) whose vehicles are all salvage."""
    # What can be no signal is left out by its texts, before any JSON is parsed; a source that is always salvage can be anywhere.
    if not always:
        desc = F.trim("description")
        may = F.lower("event_type").isin("title_status", "total_loss", "flood_damage"), F.col("metadata").rlike(SIGNAL_FIELDS), desc.rlike(text.TITLE_TEXT), desc.rlike(text.MAY_BE_SALVAGE)
        events = kept(events, F.greatest(*(F.coalesce(c, F.lit(False)) for c in may)))
    events = with_meta(events)
    m, raw, no = F.col("_m"), F.col("metadata"), F.lit(False)
    field = F.coalesce(F.lower(meta.text(m, "field")), F.lit(""))
    # What a field is takes a parse of the whole text, so it is asked only where the field holds something.
    kind_of = lambda name: F.when(meta.field(m, name).isNotNull(), meta.kind(raw, name))
    # In layers, so that no expression is computed twice. There is no filter, which Spark would push below them with all that it needs: rows without a signal have no order.
    rows = events.select(
        "vehicle_id", F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)).alias("o"), F.lower(F.coalesce("event_type", F.lit(""))).alias("kind"), F.trim(F.coalesce("description", F.lit(""))).alias("desc"),
        F.when(kind_of("value") == "STRING", meta.text(m, "value")).alias("value"), meta.text(m, "title").alias("named"), meta.text(m, "damageClass").alias("damage"), field.alias("field"),
        F.when(kind_of("salvage") == "BOOLEAN", meta.flag(m, "salvage")).alias("flag"), meta.number(m, "totalLossCnt").alias("losses"), meta.number(m, "floodTotalLossCnt").alias("floods"), meta.number(m, "value").alias("n"),
        kind_of("floodTotalLossCnt").rlike("INT|DOUBLE|FLOAT|DECIMAL").alias("flood_number"), meta.text(m, "state").alias("state"), meta.text(m, "status").alias("status"), F.coalesce(meta.text(m, "date"), dates.day_of(F.col("occurred_at"))).alias("day"),
        meta.text(m, "source").alias("source"),
    )
    rows = rows.withColumns({
        "field": F.replace("field", F.lit("-"), F.lit("_")), "bare": F.regexp_replace("field", "[-_]", ""), "of_value": text.salvage(F.col("value")), "of_desc": text.salvage(F.col("desc")), "of_damage": text.salvage(F.col("damage")),
        "zero": text.zero_losses(F.col("desc")), "stated": F.coalesce("value", "named", "damage", text.said_title(F.col("desc"))), "marked": F.coalesce(F.col("source").rlike(always), no) if always else no,
    })
    kind, name, bare = F.col("kind"), F.col("field"), F.col("bare")
    zero = F.col("zero") | F.coalesce(F.when(name.isin(*COUNT_FIELDS), F.coalesce("losses", "floods", "n")) <= 0, no)
    signal = (
        F.when(zero, False).when(kind.isin("title_status", "total_loss") | F.col("flag").isNotNull() | name.isin(*TITLE_FIELDS), True).when(bare == "vehiclecategory", F.col("of_value") | F.col("of_desc"))
        .when(F.when(bare == "totalloss", F.coalesce("losses", "n")) <= 0, False).when(bare.isin(*FLAG_FIELDS), True)
        .otherwise(F.col("of_damage") | F.col("of_value") | F.col("of_desc") | F.col("desc").rlike(text.TITLE_TEXT) | F.coalesce((kind == "flood_damage") & (F.col("floods") > 0), no))
    )
    flagged = F.coalesce("flag", no) | (kind == "total_loss") | F.coalesce((F.col("floods") > 0) & F.col("flood_number"), no) | text.salvage(F.col("stated")) | F.col("of_desc") | F.col("of_damage")
    rows = rows.withColumns({"signal": signal, "f": flagged, "usable": F.when(~F.col("stated").rlike("(?i)^(0|none|n/?a|-)$"), F.col("stated"))})
    is_loss, is_title = (kind == "total_loss") | name.isin("totalloss", "total_loss"), name.isin(*TITLE_FIELDS) | F.startswith(name, F.lit("title"))
    labelled = F.nullif(text.loss_label(F.coalesce("usable", "desc")), F.lit(""))
    title = (
        F.when(F.col("usable").isNull(), F.when(kind == "total_loss", "Total loss").when(F.col("f"), labelled)).when(name == "detailed_title", None).when(is_loss, labelled).when(is_title, F.col("usable")).when(F.col("f"), labelled)
    )
    rows = rows.withColumns({
        "title": title, "detailed_title": F.when(name == "detailed_title", F.col("usable")), "state": F.coalesce("state", text.title_state(F.col("stated"))), "says": F.col("f") | F.col("stated").isNotNull() | F.col("flag").isNotNull(),
        "o": F.when(F.col("signal"), F.col("o")),
    })
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c)
    of_signals = lambda n, c: F.coalesce(F.bool_or(F.when(F.col("signal"), c)), no).alias(n)
    one = rows.groupBy("vehicle_id").agg(
        of_signals("f", F.col("f")), of_signals("stands", F.col("flag").isNotNull()), of_signals("says", F.col("says")), F.bool_or("marked").alias("marked"), F.min(F.when(F.col("marked"), F.col("source"))).alias("by"),
        *(pick(c) for c in ("title", "detailed_title", "state", "status", "day", "source")),
    )
    titled, marked = F.coalesce("title", "detailed_title").isNotNull(), F.col("marked")
    there = marked | ((titled | F.col("status").isNotNull() | F.col("f") | F.col("stands")) & (F.col("says") | titled))
    title, source = F.coalesce("title", F.when(marked, F.lit("Salvage"))), F.coalesce("source", F.when(marked, F.col("by")))
    return one.filter(there).select("vehicle_id", (F.col("f") | marked).alias("salvage"), title.alias("title"), "detailed_title", "state", "status", "day", source.alias("source"))


PANEL = "array<struct<key:string,label:string,panel:string,name:string,resultCode:string,result:string,status:string,legend:string,area:string>>"


def body_panels(events: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """(vehicle_id, key, label, legend, legend_label): the marked panels of all events (E23). Metadata may hold panels as objects, or as texts like "Hood: scratch".
    Of a panel's marks the one of the highest rank stays; of equals the later."""
    none = F.array().cast("array<struct<key:string,label:string,code:string,result:string,legend:string>>")
    raw, o = F.col("_panels"), F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)).alias("o")
    as_text = F.transform(F.from_json(raw, "array<string>"), lambda x: F.when(~F.startswith(x, F.lit("{")), F.struct(F.lit(None).cast("string").alias("key"), F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("label"), F.lit(None).cast("string").alias("code"), F.trim(F.split_part(x, F.lit(":"), F.lit(2))).alias("result"), F.lit(None).cast("string").alias("legend"))))
    as_row = F.transform(F.when(F.contains(raw, F.lit("{")), F.from_json(raw, PANEL)), lambda x: F.struct(x["key"].alias("key"), F.coalesce(x["label"], x["panel"], x["name"]).alias("label"), F.coalesce(x["resultCode"], x["status"]).alias("code"), F.coalesce(x["result"], x["status"]).alias("result"), x["legend"].alias("legend")))
    # The panels are a column before they are tested and parsed, and marks before they are: a filter would be pushed below them and compute them again.
    rows = events.select("vehicle_id", o, F.get_json_object("metadata", "$.panels").alias("_panels"))
    rows = kept(rows, raw.isNotNull()).select("vehicle_id", "o", F.posexplode(F.concat(F.coalesce(as_text, none), F.coalesce(as_row, none))).alias("pos", "p")).filter("p.label IS NOT NULL")
    legend = F.when(F.col("p.legend").isin(*text.MARK_RANK), F.col("p.legend")).otherwise(text.mark(F.col("p.code"), F.coalesce("p.result", "p.label")))
    key = F.coalesce("p.key", F.regexp_replace(F.lower("p.label"), "[^a-z0-9가-힣]+", "_"))
    rows = kept(rows.select("vehicle_id", key.alias("key"), F.col("p.label").alias("label"), legend.alias("legend"), "o", "pos"), F.col("legend").isNotNull())
    best = rows.groupBy("vehicle_id", "key").agg(F.max_by(F.struct("label", "legend"), F.struct(text.mark_rank(F.col("legend")), "o", "pos")).alias("b"))
    return best.select("vehicle_id", "key", "b.label", "b.legend", text.mark_label(F.col("b.legend")).alias("legend_label"))


def extra_specs(events: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """(vehicle_id, key, value, day): specifications, each key and value once with its first day (E24); of first registrations only the most precise."""
    events, m = with_meta(events), F.col("_m")
    field = F.lower(F.regexp_replace(meta.text(m, "field"), "[^A-Za-z0-9]+", "_"))
    first = is_first_registration(F.col("event_type"), F.col("description"), m)
    key = F.when(first, "first_registration").otherwise(field)
    value = F.coalesce(meta.text(m, "value"), F.nullif(F.trim(F.regexp_extract("description", r":\s*(.+)$", 1)), F.lit("")))
    o = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)).alias("o")
    rows = events.filter(first | field.isin(*SPEC_FIELDS)).select("vehicle_id", key.alias("key"), value.alias("value"), dates.day_of(F.col("occurred_at")).alias("day"), o).filter("value IS NOT NULL")
    one = rows.groupBy("vehicle_id", "key", F.lower("value").alias("_v")).agg(F.min_by(F.struct("value", "day"), "o").alias("b"), F.min("o").alias("o")).select("vehicle_id", "key", "b.value", "b.day", "o")
    rank = F.when(F.col("key") == "first_registration", first_registration_score(F.col("value"), F.lit(""))).otherwise(0)
    n = F.row_number().over(Window.partitionBy("vehicle_id", F.when(F.col("key") == "first_registration", F.lit("")).otherwise(F.concat_ws("\x01", "key", "value"))).orderBy(rank.desc(), "o"))
    return one.withColumn("_n", n).filter("_n = 1").drop("_n", "o")


def same_day_identity(kind: Column, desc: Column, m: Column) -> Column:
    """What events of a day must share to be the same thing (E25): handoffs of a new vehicle, completed inspections, registration changes, repairs, insurance by wording
    and amount; else type and normal wording."""
    what = F.lower(F.coalesce(meta.text(m, "type"), F.lit("")))
    d = F.coalesce(desc, F.lit(""))
    insurance = F.regexp_replace(F.regexp_replace(F.lower(d), "[^a-z0-9]+", "_"), "^_|_$", "")
    return (
        F.when(is_first_registration(kind, desc, m) | (what == "new_car_delivery"), "new_vehicle_start").when((what == "inspection") | d.rlike(r"(?i)^(car|automobile)\s+inspection\s+completed\b"), "inspection_completed")
        .when((what == "registration_change") | d.rlike(r"(?i)^change\s+registration\b"), "registration_change").when(d.rlike(r"(?i)maintenance\s*/?\s*repair\s+history"), "maintenance_repair")
        .when((what == "insurance_event") | d.rlike(r"(?i)^(?:insurance\s+processing|no\s+car\s+insurance)\b"), F.concat_ws("|", F.lit("insurance"), insurance, F.coalesce(meta.text(m, "amount"), F.lit(""))))
        .otherwise(F.concat_ws("|", F.lower(F.coalesce(kind, F.lit("other"))), text.same_day_text(d)))
    )


def _clauses(said: Column) -> Column:
    """A diagnosis' clauses (an array of texts): white space tidied, names of the diagnosis at their beginnings alike, and the clause that all is well left out."""
    t = F.transform(said, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"(?i)^(?:[a-z]+ )?diagnosis\s*:\s*", "Diagnosis: ")))
    return F.filter(t, lambda x: (x != "") & ~x.rlike(r"(?i)^(?:[a-z]+ )?diagnosis\s*[—–-]"))


def _merged_diagnosis(w: WindowSpec) -> Column:
    """The description of the diagnoses of one day, over a window of all of them, the best first: the best row's beginning (or that all panels are well), and every different
    clause."""
    clear = F.when(F.bool_or(F.col("_clear")).over(w), True).when(F.bool_or(~F.col("_clear")).over(w), False)
    every = F.flatten(F.collect_list("_clauses").over(w))
    alike = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[—–−-]+", "-"), r"[/.|,;:\s]+", " "))
    outer = F.exists(every, lambda x: x.rlike("(?i)outer-panel replacement vehicle"))
    kept = F.filter(every, lambda x: F.when(F.coalesce(clear, F.lit(False)), ~x.rlike("(?i)outer-panel replacement vehicle")).otherwise(~(outer & x.rlike("(?i)no outer-panel replacements"))))
    keys = F.transform(kept, alike)
    once = F.filter(kept, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    own = F.first("description").over(w)
    head = F.when(clear, "Diagnosis — all panels normal").when(own.rlike(r"(?i)^(?:[a-z]+ )?diagnosis\s*[—–-]"), F.regexp_replace(own, r"(?i)^[a-z]+ (?=diagnosis)", ""))
    tail = F.when(F.size(once) > 0, F.array_join(once, " / "))
    return F.coalesce(F.concat(head, F.lit(". "), tail), head, tail, own, F.lit("Diagnosis"))


# Fields that stick to a vehicle, and those that are details of an inspection.
STICKY = ("inspectionReportUploaded", "odometerCheck", "hasInsuranceHistory", "steeringType")
DETAIL = r"(?i)^(?:inspection )?(?:valid from|valid until|issue date|comments?|odometer|warranty|record (?:no|number))\b.*:"


def timeline(events: DataFrame, ties: Sequence[Column | str], trusted: str = TRUSTED) -> DataFrame:
    """(vehicle_id, day, event_type, description, occurred_at): the events of the timeline (E25, W3). Accidents, sales, title and loss events have tables of their own;
    of first registrations the best stays, of owner changes one a day, of insurance gaps one a field, of rows that stick to a vehicle the oldest of each wording, of an
    inspection's rows one a day (its summary, if there is one) and a record number, and of the same thing on one day the richest. Diagnoses of a day become one row
    with every different clause. trusted: the source whose rows are richer.

    Sources of diagnoses and inspections are those that end in _diagnosis, _inspection and _inspection_panels."""
    m, desc = F.col("_m"), F.coalesce("description", F.lit(""))
    kind = F.lower("event_type")
    rows = with_meta(events.filter(~is_accident(F.col("event_type")) & ~kind.isin("sale", "title_status", "total_loss") & ~text.salvage(desc)))
    # What several expressions need is a column first, so that it is computed once.
    rows = rows.withColumns({
        "_first": is_first_registration(F.col("event_type"), F.col("description"), m), "_field": F.coalesce(meta.text(m, "field"), F.lit("")), "_value": meta.text(m, "value"), "_source": F.coalesce(meta.text(m, "source"), F.lit("")), "_date": meta.text(m, "date"),
        "_read": meta.text(m, "mileageKm", "mileage").isNotNull(), "_odo": meta.text(m, "odometer").isNotNull(), "_seq": meta.text(m, "sequence").isNotNull(), "_plate": meta.text(m, "plate", "carNo").isNotNull(), "_amount": meta.text(m, "amount").isNotNull(),
        "_id": same_day_identity(F.col("event_type"), F.col("description"), m), "_no": meta.text(m, "diagnosisNo"), "_body": F.coalesce(meta.flag(m, "bodyCondition"), F.lit(False)), "_clear": meta.flag(m, "allClear"),
        "_panels": F.size(F.from_json(meta.field(m, "panels"), "array<string>")), "_comments": F.from_json(meta.field(m, "comments"), "array<string>"), "_record": meta.text(m, "recordNo"), "_valid": meta.text(m, "validityStartDate", "validityEndDate").isNotNull(),
        "_issued": meta.text(m, "issueDate"), "_sticky": F.coalesce(meta.flag(m, "sticky"), F.lit(False)), "_born": dates.day(meta.text(m, "firstRegistrationDate")),
    }).drop("_m")
    first, owner, points = F.col("_first"), kind == "owner_change", lambda c, n: F.when(c, n).otherwise(0)
    gap = F.col("_field").rlike(r"(?i)^notJoinDate\d+$") | desc.rlike(r"(?i)^insurance coverage gap\s*:")
    source = F.lower("_source")
    diagnosis = F.endswith(source, F.lit("_diagnosis")) | F.col("_body") | F.col("_no").isNotNull() | desc.rlike(r"(?i)^(?:[a-z]+ )?diagnosis\b")
    panel = F.endswith(source, F.lit("_inspection_panels")) | desc.rlike(r"(?i)^inspection (?:findings|panel notes)\b")
    summary = ~panel & desc.rlike(r"(?i)^(?:[a-z]+ )?performance inspection\b") | (~panel & (kind == "inspection") & F.endswith(source, F.lit("_inspection")) & ~desc.rlike(DETAIL))
    detail = desc.rlike(DETAIL) & F.endswith(source, F.lit("_inspection"))
    own_day = dates.day_of(F.col("occurred_at"))
    day = F.coalesce(own_day, dates.day(F.col("_date")), F.lit("unknown"))
    inspected = F.coalesce(F.when(F.col("_born").isNull() | (own_day != F.col("_born")), own_day), F.col("_issued"), F.col("_date"), F.lit("unknown"))
    owner_score = (
        points(F.col("_read"), 50) + points(desc.rlike(r"(?i)\d[\d,]*\s*km"), 40) + points(desc.rlike(r"(?i)owner change\s+\d+\s+of\s+\d+"), 30)
        + points(F.col("_seq"), 10) + points(F.col("_plate"), 8) - F.when(desc.rlike("(?i)^ownership$"), 5).when(desc.rlike("(?i)^owner change$"), 3).otherwise(0)
    )
    gap_score = F.when(desc.rlike(r"\d{4}-\d{2}\s+to\s+\d{4}-\d{2}"), 100).when(desc.rlike(r"\d{6}\s+to\s+\d{6}"), 40).otherwise(0) + F.least(F.length(desc), F.lit(80))
    diagnosis_score = (
        points(F.col("_no").isNotNull(), 100) + points(F.col("_body"), 40) + points(F.col("_clear"), 30) + F.when(F.col("_panels") >= 0, 20 + F.least("_panels", F.lit(10))).otherwise(0) + points(F.col("_comments").isNotNull(), 15)
        + points(kind == "inspection", 25) + points(desc.rlike("(?i)all panels normal"), 10) + F.least(F.length(desc), F.lit(200)) / 20
    )
    inspection_score = (
        F.length(desc) + points(summary, 10_000) + points(desc.rlike(r"(?i)^[a-z]+ performance inspection\b"), 500) + points(F.col("_read"), 50) + points(F.col("_record").isNotNull(), 40) + points(F.col("_comments").isNotNull(), 30) + points(F.col("_valid"), 20)
    )
    rich = (
        F.length(desc) + F.when(desc.rlike(r"(?i)new\s*car\s*delivery"), 80).when(desc.rlike(r"(?i)new\s*car\s*shipment"), 40).otherwise(0) + points(F.col("_read") | F.col("_odo"), 50)
        + points(F.col("_amount"), 20) + points(F.col("_source") == trusted, 30) + points(kind == "delivery", 25)
    )
    rows = rows.withColumns({"day": day, "_r": rich, "_gap": gap, "_diag": diagnosis & ~first & ~owner, "_insp": (summary | panel | detail) & ~first & ~owner, "_stick": F.col("_sticky") | F.col("_field").isin(*STICKY)})
    group = (
        F.when(first, F.lit("first")).when(F.col("_insp"), F.concat(F.lit("inspection|"), inspected)).when(owner, F.concat(F.lit("owner|"), F.coalesce("_date", "day"))).when(F.col("_diag"), F.concat(F.lit("diagnosis|"), "day"))
        .when(F.col("_gap"), F.concat(F.lit("gap|"), "_field")).when(F.col("_stick"), F.concat_ws("|", F.lit("sticky"), kind, F.lower(desc))).otherwise(F.concat_ws("|", F.lit("day"), "day", "_id"))
    )
    score = (
        F.when(first, first_registration_score(F.col("_value"), F.col("_source"))).when(F.col("_insp"), inspection_score).when(owner, owner_score).when(F.col("_diag"), diagnosis_score).when(F.col("_gap"), gap_score)
        .when(F.col("_stick"), 0).otherwise(F.col("_r"))
    )
    clauses = F.when(F.col("_diag"), _clauses(F.concat(F.coalesce("_comments", F.array().cast("array<string>")), F.split(desc, r"\s*/\s*"))))
    record = F.when(F.col("_insp") & F.col("_record").isNotNull(), F.concat(F.lit("record|"), "_record"))
    rows = rows.withColumns({"_g": group, "_s": score.cast("double"), "_clauses": clauses, "_again": record})
    others = [t for t in ties if t not in ("event_type", "description", "occurred_at")]
    rows = rows.select("vehicle_id", "day", "event_type", "description", "occurred_at", "_id", "_r", "_g", "_s", "_diag", "_clear", "_clauses", "_again", *others)
    # One shuffle: groups, records and days are the vehicle's.
    rows = rows.repartition("vehicle_id")
    best = [F.col("_s").desc(), F.col("occurred_at").asc_nulls_last(), *ties]
    # All windows of a group take the order in which the best is first, so that one sort serves them: each sort holds a task's rows.
    whole = run_window(["vehicle_id", "_g"], best).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    many = F.count(F.lit(1)).over(whole) > 1
    rows = rows.withColumn("description", F.when(F.col("_diag") & many, _merged_diagnosis(whole)).otherwise(F.col("description"))).drop("_clear", "_clauses")
    rows = first_per_key(rows, ["vehicle_id", "_g"], best)
    rows = rows.withColumn("_again", F.coalesce("_again", "_g"))
    rows = first_per_key(rows, ["vehicle_id", "_again"], [F.col("_s").desc(), F.col("occurred_at").asc_nulls_last(), *ties])
    # Rows of one day that say the same. Diagnoses and inspections are one a day already; their words are not compared.
    same = F.when(F.col("_diag") | F.startswith("_g", F.lit("inspection|")), F.col("_g")).otherwise(F.col("_id"))
    rows = first_per_key(rows.withColumn("_same", same), ["vehicle_id", "day", "_same"], [F.col("_r").desc(), F.col("occurred_at").asc_nulls_last(), *ties])
    return rows.select("vehicle_id", "day", "event_type", "description", "occurred_at")


def with_readings(line: DataFrame, history: DataFrame) -> DataFrame:
    """The timeline and an entry for each odometer reading that no event of the same day and distance covers (E26, U7): the history says which are."""
    more = history.filter(~F.col("of_event"))
    desc = F.concat(F.lit("Odometer reading: "), F.format_number("km", 0), F.lit(" km"))
    rows = more.select("vehicle_id", "day", F.lit("mileage").alias("event_type"), desc.alias("description"), F.to_timestamp_ntz("day", F.lit("yyyy-MM-dd")).alias("occurred_at"))
    return line.unionByName(rows)


def report(vehicles: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """A row for each vehicle with an array of structs for each section (E27), in the order of their fields; null where a vehicle has none.

    The sections' rows meet in one union, each as a struct in its section's column, and in one aggregation by vehicle, so neither rows nor shuffles multiply with sections."""
    rows = [df.select("vehicle_id", F.struct(*(c for c in df.columns if c != "vehicle_id")).alias(name)) for name, df in sections.items()]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    lists = [F.array_sort(F.collect_list(name)) for name in sections]
    nested = whole.groupBy(F.col("vehicle_id").alias("_v")).agg(*(F.when(F.size(x) > 0, x).alias(name) for name, x in zip(sections, lists)))
    return vehicles.join(nested, vehicles.id == F.col("_v"), "left").drop("_v")


def report_sums(vehicles: DataFrame, sections: dict[str, DataFrame], **more: Column) -> DataFrame:
    """A row for each vehicle (id, and its other columns) with the number of rows that its report would hold of each section, and `more`: aggregates over the sections' columns
    of those names, null where a vehicle has none. Nothing is nested: rows are counted where they are, before the shuffle."""
    rows = None
    for name, df in sections.items():
        one = df.select("vehicle_id", F.lit(name).alias("_section"), *(c for c in more if c in df.columns))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    counts = [F.count_if(F.col("_section") == name).alias(name) for name in sections]
    sums = rows.groupBy(F.col("vehicle_id").alias("_v")).agg(*counts, *(c.alias(n) for n, c in more.items()))
    return vehicles.join(sums, vehicles.id == F.col("_v"), "left").drop("_v").na.fill(0, list(sections))


def sold_observations(listings: DataFrame, *ties: str) -> DataFrame:
    """Listings whose status is sold, as auction_sales takes them, with the columns source_id, provider, price_usd and price_eur if they are there, and those of ties."""
    more = {"source_id": "source_id", "provider": "provider", "price_usd": "usd", "price_eur": "eur"}
    given = [F.col(c).alias(n) for c, n in more.items() if c in listings.columns]
    return listings.filter(status_key(F.col("listing_status")) == "sold").select("vehicle_id", dates.day_of(F.col("seen_at")).alias("day"), F.col("price_amount").cast("double").alias("amount"), F.col("price_currency").alias("currency"), *given, *ties)
