"""Operators on small tables: edge cases, invariants, and the same result for any order of rows."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from vinlake.operators import history as H
from vinlake.operators import ingest as I
from vinlake.operators import joins as J
from vinlake.operators.filters import LiveSearch, live_conditions
from vinlake.operators import limits as L
from vinlake.operators import photos as P
from vinlake.operators import shards as S
from vinlake.operators import windows as W
from vinlake.operators.registry_records import record_events
from vinlake.sources import domain as D
from vinlake.sources import readers as R
from vinlake.sources import writers as K

EVENT = "vehicle_id long, pos int, event_type string, description string, metadata string, occurred_at timestamp_ntz"


def events(spark, *rows):
    out = [(v, i, kind, desc, m if m is None or isinstance(m, str) else json.dumps(m), dt.datetime.fromisoformat(at) if at else None) for i, (v, kind, desc, m, at) in enumerate(rows)]
    return spark.createDataFrame(out, EVENT)


def as_set(df, *cols):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect()}


def test_mileage_plateaus(spark):
    rows = [(1, f"2020-01-0{i}", 50_000, "listing", f"s{i}") for i in range(1, 6)] + [(1, "2020-01-03", 50_000, "owner", "o"), (1, "2020-02-01", 60_000, "listing", "s"), (1, "2020-02-01", 60_000, "inspection", "i"), (1, None, 1, "listing", "x"), (1, "2020-03-01", 1, "other", "x"), (2, "2020-01-01", 9, "other", "x")]
    df = spark.createDataFrame(rows, "vehicle_id long, day string, km long, kind string, source string").withColumn("of_event", F.col("kind") != "listing")
    got = H.mileage_history(df.limit(3), df)
    assert as_set(got.filter("vehicle_id = 1"), "day", "km", "kind", "sources", "latest") == {
        ("2020-01-01", 50_000, "listing", ("s1", "s2"), False), ("2020-01-02", 50_000, "listing", ("s1", "s2"), False), ("2020-01-03", 50_000, "owner", ("o", "s3"), False),
        ("2020-01-04", 50_000, "listing", ("s4", "s5"), False), ("2020-01-05", 50_000, "listing", ("s4", "s5"), False), ("2020-02-01", 60_000, "inspection", ("i", "s"), True),
    }
    assert as_set(got.filter("vehicle_id = 2"), "day", "latest") == {("2020-01-01", True)}


def test_readings_of_events(spark):
    e = events(
        spark, (1, "inspection", None, {"mileageKm": "60,000 km", "issueDate": "2020-05-01"}, "2021-01-01"), (2, "other", "84,431 miles", {"unit": "mi"}, "2021-01-01"), (3, "delivery", None, {"km": 5000, "firstRegistrationDate": "2021-01-01"}, "2021-01-01"),
        (4, "sale", None, {"miles": 10}, "2021-01-02"), (5, "other", "no reading", "broken", "2021-01-02"), (6, "x", None, {"mileageKm": 1, "mileage": 700}, None),
    )
    assert as_set(H.event_readings(e), "vehicle_id", "day", "km", "kind") == {(1, "2020-05-01", 60_000, "inspection"), (2, "2021-01-01", 135879, "other"), (3, None, 5000, "other"), (4, "2021-01-02", 16, "sale"), (5, "2021-01-02", None, "other"), (6, None, 700, "other")}


def test_accidents(spark):
    e = events(spark, (1, "accident", "hit", {"partCost": 5, "laborCost": "7"}, "2020-01-01"), (1, "accident", None, {"repairTotal": 3, "partCost": 9}, "2020-01-02"), (1, "accident", " ", {}, "2020-01-03"), (1, "flood_damage", "wet", None, None), (1, "other", "Primary damage", {"field": "primary_damage"}, "2020-01-01"))
    assert as_set(H.accidents(e), "day", "type", "category", "repair_total") == {("2020-01-01", "accident", None, 12.0), ("2020-01-02", "accident", None, 3.0), ("Unknown date", "flood_damage", "flood", None)}


def test_owners(spark):
    e = events(
        spark, (1, "owner_change", "Owner change", {"source": "auction"}, "2020-01-01"), (1, "owner_change", "to a dealer", {"mileageKm": 4, "source": "auction"}, "2020-01-01"), (1, "inspection", None, {"carNo": "P9"}, "2020-01-01"),
        (1, "owner_change", "Ownership", {"date": "2019-01-01"}, "2020-06-01"), (1, "sale", None, {}, "2020-01-01"),
    )
    assert as_set(H.owner_changes(e, ["pos"]), "day", "sequence", "info", "plate", "km", "source") == {("2019-01-01", 1, None, None, None, "registry"), ("2020-01-01", 2, "to a dealer", "P9", 4.0, "auction")}


def test_sales_cover(spark):
    e = events(spark, (1, "sale", None, {"amount": 100, "currency": "USD"}, "2020-01-01"), (1, "sale", "Sold for: $200", {"soldDate": "2020-01-02"}, "2020-01-05"), (1, "sale", None, {}, "2020-01-09"), (1, "sale", None, {"amount": 100}, "2020-01-01"))
    o = spark.createDataFrame([(1, "2021-01-01", 100.0, "USD"), (1, "2020-01-09", 500.0, "USD"), (1, "2022-01-01", 700.0, "EUR"), (1, "2022-01-01", 700.0, "EUR"), (1, "2023-01-01", None, "EUR")], "vehicle_id long, day string, amount double, currency string")
    want = {("2020-01-01", 100.0, True), ("2020-01-02", 200.0, True), ("2020-01-09", 500.0, True), ("2022-01-01", 700.0, False), ("2023-01-01", None, False)}
    assert as_set(H.auction_sales(e, o, ["pos"]), "day", "amount", "from_event") == want
    assert as_set(H.auction_sales(e.orderBy(F.rand(1)), o.orderBy(F.rand(2)), ["pos"]), "day", "amount", "from_event") == want


def fold_of_sales(sales, seen):
    """A vehicle's list of sales, one observation after the other."""
    rows = [dict(r) for r in sales]
    for o in seen:
        for r in rows:
            same = lambda c: o[c] is not None and r[c] == o[c]  # noqa: B023, E731
            if same("source_id") or same("amount") or (r["day"] == o["day"] and None in (r["amount"], o["amount"])):
                names = [x for x in (o["provider"], r["provider"]) if x]
                r["provider"] = next((x for x in names if x != "mirror"), names[0] if names else None)
                for c in ("amount", "usd", "eur", "source_id"):
                    r[c] = r[c] if r[c] is not None else o[c]
                break
        else:
            rows.append(dict(o, source="observation"))
    return rows


def test_sales_fold_against_a_loop(spark):
    """Chains: a sale takes an observation's source id or amount and then covers others by it, in the order of days; repeated rows change nothing."""
    rng, cols = random.Random(8), ("day", "amount", "usd", "eur", "provider", "source_id")
    e_rows, o_rows, want = [], [], set()
    for v in range(60):
        seen, sales, done = [], [], set()
        for pos in range(rng.randrange(4)):
            day, amount = f"2020-01-0{rng.randint(1, 5)}", rng.choice([None, 1.0, 2.0, 3.0])
            m = {"soldDate": day, "amount": amount, "sourceListingId": rng.choice([None, "s1", "s2"]), "provider": rng.choice([None, "mirror", "p1"]), "currency": "EUR", "source": "x"}
            e_rows.append((v, "sale", None, m, f"2020-01-{10 + pos}"))
            if (day, amount) not in done:  # the loop gets one event for each day and amount
                done.add((day, amount))
                sales.append({"day": day, "amount": amount, "usd": None, "eur": None, "provider": {None: "x", "mirror": None, "p1": "p1"}[m["provider"]], "source_id": m["sourceListingId"], "source": "x"})
            else:
                e_rows.pop()
        for at in range(rng.randrange(9)):
            o = {"day": f"2020-01-0{rng.randint(1, 5)}", "amount": rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0]), "usd": rng.choice([None, 9.0]), "eur": rng.choice([None, 8.0]), "provider": rng.choice([None, "mirror", "p2", "p3"]), "source_id": rng.choice([None, "s1", "s2", "s3", "s4"])}
            seen += [o] * rng.choice([1, 1, 3])
        seen.sort(key=lambda o: o["day"])
        seen = [dict(o, n=n) for n, o in enumerate(seen)]
        o_rows += [(v, *(o[c] for c in cols), o["n"]) for o in seen]
        want |= {(v, *(r[c] for c in cols), r["source"] != "observation") for r in fold_of_sales(sales, seen)}
    e = events(spark, *e_rows)
    o = spark.createDataFrame(o_rows, "vehicle_id long, day string, amount double, usd double, eur double, provider string, source_id string, n int")
    for _ in range(2):
        out = H.auction_sales(e, o, ["pos"], ["n"])
        assert as_set(out, "vehicle_id", *cols, "from_event") == want and out.count() == len(want)
        e, o = e.orderBy(F.rand(1)), o.orderBy(F.rand(2))


def test_sale_events_and_registrations(spark):
    e = events(
        spark, (1, "sale", "Sold for: $1,200", {"field": "final_price", "value": 900}, "2020-01-01"), (2, "sale", None, {"finalPrice": 500, "registered": "2001"}, "2020-01-01"), (3, "sale", None, {"amount": 70, "provider": "iaa"}, "2020-01-01"),
        (4, "sale", None, {"amount": 70, "source": "kmarket"}, "2020-01-01"), (4, "delivery", "First registration: 2009", {"field": "firstRegistration"}, "2009-01-01"), (4, "delivery", "New car delivery", {"kind": "firstDate", "value": "2009-05-04T00:00"}, "2010-01-01"),
        (5, "sale", None, {"amount": 1, "registered": None}, "2020-01-01"), (5, "sale", None, {"amount": 1, "registered": "2003-02", "soldDate": "2020-01-01"}, "2020-01-02"), (5, "other", "First registration: x", {"field": "firstDate", "datePrecision": "month"}, "2004-03-01"),
        (6, "sale", None, {"amount": 1}, None), (7, "sale", None, {"finalPrice": 600000}, "2020-01-01"),
    )
    got = as_set(H.auction_sales(e, spark.createDataFrame([], "vehicle_id long, day string, amount double, currency string"), ["pos"], won="kmarket"), "vehicle_id", "amount", "currency", "usd", "registered", "provider", "source")
    assert got == {
        (1, 900.0, "USD", None, None, None, "sale_event"), (2, 500.0, "USD", 500.0, "2001", None, "sale_event"), (3, 70.0, "USD", 70.0, None, "iaa", "sale_event"), (4, 70.0, "KRW", None, "2009-05-04", "kmarket", "kmarket"),
        (5, 1.0, "USD", None, "2004-03", None, "sale_event"), (7, 600000.0, "USD", None, None, None, "sale_event"),
    }


def test_salvage_rules(spark):
    """Counts belong to fields of counts: a title or a flood that also states zero losses stays; hyphens are underscores; a description can state a title."""
    e = events(
        spark, (1, "title_status", None, {"salvage": True, "totalLossCnt": 0}, "2020-01-01"), (2, "flood_damage", "Flood", {"totalLossCnt": 0, "floodTotalLossCnt": 2}, "2020-01-01"), (3, "other", None, {"field": "total-loss", "value": 0}, "2020-01-01"),
        (4, "other", "Title: Clear", None, "2020-01-01"), (5, "other", None, {"field": "vehicle-category", "value": "car"}, "2020-01-01"), (6, "other", None, {"field": "total_loss_count", "value": 2}, "2020-01-01"), (7, "title_status", None, {"field": "title", "value": 7}, "2020-01-01"),
        (8, "other", "listed as salvage today", {"salvage": "true"}, "2020-01-01"), (9, "title_status", None, {"value": "0", "salvage": False}, "2020-01-01"), (10, "other", "seen", {"source": "wreckers"}, "2020-01-01"), (11, "flood_damage", None, {"floodTotalLossCnt": "2"}, None),
    )
    got = as_set(H.salvage_records(e, ["pos"], always="wreck"), "vehicle_id", "salvage", "title", "detailed_title", "source")
    assert got == {(1, True, None, None, None), (2, True, "Flood", None, None), (4, False, None, None, None), (8, True, "Salvage", None, None), (9, False, None, None, None), (10, True, "Salvage", None, "wreckers")} - {(4, False, None, None, None)}


def test_salvage(spark):
    e = events(
        spark, (1, "title_status", None, {"field": "title", "value": "TX - Salvage", "status": "final"}, "2020-01-01"), (1, "total_loss", "Total loss", {"date": "2019-05-05"}, "2020-01-02"), (2, "other", "Total loss: 0", {"field": "total_loss_count", "value": 0}, "2020-01-01"),
        (3, "title_status", None, {"salvage": False, "value": "CA - Clear"}, "2020-01-01"), (4, "other", "nothing", {}, None), (5, "flood_damage", None, {"floodTotalLossCnt": 1}, None),
    )
    assert as_set(H.salvage_records(e, ["pos"]), "vehicle_id", "salvage", "title", "state", "status", "day") == {(1, True, "TX - Salvage", "TX", "final", "2020-01-01"), (3, False, None, "CA", None, "2020-01-01"), (5, True, None, None, None, None)}  # a value names a title only in a title's field, or where it flags


def test_timeline(spark):
    e = events(
        spark, (1, "delivery", "New car delivery", {"field": "firstDate", "value": "2015"}, "2015-01-01"), (1, "delivery", "First registration: 2015-03-04", {"field": "firstDate", "value": "2015-03-04"}, "2015-03-04"), (1, "owner_change", "Owner change", {}, "2016-01-01"),
        (1, "owner_change", "Owner change 1 of 2", {"sequence": 1}, "2016-01-01"), (1, "accident", "hit", {}, "2016-02-01"), (1, "sale", "x", {}, "2016-02-01"), (1, "other", "Automobile inspection completed (ok)", {}, "2017-01-01"), (1, "other", "Car inspection completed, long text", {}, "2017-01-01"),
        (1, "other", "insurance coverage gap: 202001 to 202002", {"field": "notJoinDate1"}, "2020-01-01"), (1, "other", "Insurance coverage gap: 2020-01 to 2020-02", {"field": "notJoinDate1"}, "2020-03-01"),
    )
    want = {("2015-03-04", "First registration: 2015-03-04"), ("2016-01-01", "Owner change 1 of 2"), ("2017-01-01", "Automobile inspection completed (ok)"), ("2020-03-01", "Insurance coverage gap: 2020-01 to 2020-02")}
    assert as_set(H.timeline(e, ["pos"]), "day", "description") == want
    assert as_set(H.timeline(e.orderBy(F.rand(3)), ["pos"]), "day", "description") == want


def test_timeline_of_diagnoses_inspections_and_sticky_rows(spark):
    d, i = {"source": "x_diagnosis"}, {"source": "x_inspection"}
    e = events(
        spark, (1, "other", "X diagnosis — all panels normal", d | {"diagnosisNo": 7, "allClear": True, "comments": ["Fine  car", "Outer-panel replacement vehicle"]}, "2020-01-01"), (1, "other", "diagnosis: no leaks / fine car.", d, "2020-01-01"),
        (1, "other", "No leaks", d | {"comments": ["X diagnosis: no leaks"]}, "2020-01-02"), (1, "inspection", "X performance inspection, 5 km", i | {"recordNo": "9"}, "2020-02-01"), (1, "other", "Comments: none at all, and a long text beside", i, "2020-02-01"),
        (1, "other", "Inspection findings: hood", {"source": "x_inspection_panels"}, "2020-02-01"), (1, "inspection", "X performance inspection", i | {"recordNo": "9"}, "2020-03-01"), (1, "other", "Odometer: 7", i, "2020-04-01"),
        (1, "other", "Steering: left", {"field": "steeringType"}, "2020-05-02"), (1, "other", "steering: LEFT", {"field": "steeringType"}, "2020-05-01"), (1, "other", "Note", {"sticky": True}, "2020-05-03"), (1, "other", "Note", {}, "2020-05-04"),
    )
    want = {
        ("2020-01-01", "Diagnosis — all panels normal. Fine  car / Diagnosis: no leaks".replace("  ", " ")), ("2020-01-02", "No leaks"), ("2020-02-01", "X performance inspection, 5 km"), ("2020-04-01", "Odometer: 7"),
        ("2020-05-01", "steering: LEFT"), ("2020-05-03", "Note"), ("2020-05-04", "Note"),
    }
    assert as_set(H.timeline(e, ["pos"]), "day", "description") == want
    assert as_set(H.timeline(e.orderBy(F.rand(3)), ["pos"]), "day", "description") == want


def test_body_panels(spark):
    e = events(spark, (1, "x", None, {"panels": [{"label": "Hood", "result": "scratch"}, {"panel": "Hood", "status": "replacement"}, {"name": "Roof", "result": "normal"}, {"key": "d", "label": "Door", "legend": "R"}]}, "2020-01-01"), (1, "x", None, {"panels": ["Trunk: dent", "Trunk: crack"]}, "2020-01-02"), (2, "x", None, "not json", None))
    assert as_set(H.body_panels(e, ["pos"]), "key", "label", "legend") == {("hood", "Hood", "Z"), ("d", "Door", "R"), ("trunk", "Trunk", "P")}


def test_vehicle_merge_is_a_fold_in_time_order(spark):
    """The closed form against a fold over records in order of time, for several shuffles."""
    rng = random.Random(4)
    rows = [(v, t, rng.choice([None, "", "red", "blue", "green"]), rng.choice([None, 0, 5_000, 90_000]), rng.choice([None, "kr", "de", "jp", "ge"])) for v in range(12) for t in rng.sample(range(100), 8)]
    trusted, want = {"Germany", "Japan"}, {}
    names = {"kr": "South Korea", "de": "Germany", "jp": "Japan", "ge": "Georgia"}
    for v in range(12):
        color = km = last = proof = None
        for _, _, c, k, p in sorted(r for r in rows if r[0] == v):
            color, km = c or color, max((x for x in (km, k) if x and x > 1), default=None)
            last, proof = names.get(p, last), names[p] if p and names[p] in trusted else proof
        want[v] = (color, km, proof or last if last == "South Korea" else last)
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "vehicle_id long, t int, color string, km long, country string")
        got = I.newest_vehicle(df, "vehicle_id", "t", ["color"], [])
        assert {r.vehicle_id: (r.color, r.current_km, r.country) for r in got.collect()} == want


def test_append_is_idempotent_and_order_free(spark):
    x = D.listings(spark, SF_DIR).limit(3000)
    order = ["seen_at", "source_id", "price_currency", "mileage_unit", "listing_status", "location"]
    once = I.appended(x.limit(0), x, order)
    keys = ["vehicle_id", "provider_id", "price_amount", "mileage", I.status_key(F.col("listing_status"))]
    assert once.count() == once.select(*keys).distinct().count() == x.select(*keys).distinct().count()
    assert I.appended(once, x, order).isEmpty()
    assert as_set(I.appended(x.limit(0), x.orderBy(F.rand(9)), order), *x.columns) == as_set(once, *x.columns)


def test_observed_at_and_clones(spark):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    pick = lambda *a: spark.range(1).select(I.observed_at(*a).alias("x")).first().x
    assert pick(F.lit("sold"), ts("2020-05-01"), ts("2020-01-01"), ts(None), now) == dt.datetime(2020, 5, 1)
    assert pick(F.lit("active"), ts("2020-05-01"), ts("1989-01-01"), ts("2021-01-01"), now) == dt.datetime(2021, 1, 1)
    assert pick(F.lit("active"), ts(None), ts("2024-06-01"), ts(None), now) == dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, "VIN1234567890", 5, None), (2, 1, "VIN1234567890", 5, None), (3, 1, "VIN1234567890", 5, 7), (4, 1, "short", 5, None), (5, 1, "short", 5, None), (6, 1, None, 5, None)], "id long, provider_id long, vin string, price_amount long, mileage long")
    assert as_set(I.clone_ids(rows), "id", "keep") == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)}


def test_gates(spark):
    rows = [("1M8GDM9AXKP042788", 5.0, "Make", "Model", 2), ("bad", 5.0, "Make", "Model", 2), ("1M8GDM9AXKP042788", 1.0, "Make", "Model", 2), ("1M8GDM9AXKP042788", 5.0, " ", "Model", 2), ("1M8GDM9AXKP042788", 5.0, "Make", "Model", None)]
    got = I.gated(spark.createDataFrame(rows, "vin string, mileage double, make string, model string, usable_photos int")).collect()
    assert [r.gate_reason for r in got] == [None, "vin", "mileage", "identity", "photos"]


def test_galleries(spark):
    photos = D.photos(spark, SF_DIR)
    got = P.galleries(photos, P.canonical_listings(photos), most=5)
    per = got.groupBy("vehicle_id", "photo_group").agg(F.count_if(F.col("shown")).alias("shown"), F.count_if(F.col("is_primary")).alias("lead"), F.count_distinct("sort_order").alias("places"), F.count("*").alias("n"), F.count_distinct("picture").alias("pictures"))
    for r in per.collect():
        assert r.shown <= (5 if r.photo_group == "gallery" else 72) and r.places == r.n == r.pictures and r.lead == (r.photo_group == "gallery")


def test_canonical_listings(spark):
    rows = [(1, 10, "https://a.example/1.jpg"), (1, 10, "https://a.example/2.jpg"), (1, 11, "https://mirror.example/1.jpg"), (1, 12, "https://b.example/1.jpg"), (2, 20, "https://a.example/1.jpg"), (3, 30, "https://mirror.example/x"), (3, 31, "https://b.example/x")]
    photos = spark.createDataFrame(rows, "vehicle_id long, listing_id long, source_url string")
    meta = spark.createDataFrame([(10, "catalog:7", True), (11, "lot/5", True), (12, "123456", False), (30, "lot/9", True), (31, "x", False)], "listing_id long, source_id string, is_active boolean")
    hosts = ((r"(?i)b\.example", 120), (r"(?i)mirror\.example", -250))
    pick = lambda **k: as_set(P.canonical_listings(photos, meta, hosts=hosts, **k), "vehicle_id", "canonical")
    assert pick() == {(1, 12), (2, 20), (3, 31)}
    wish = lambda *x: spark.createDataFrame(x, "vehicle_id long, preferred long")
    assert pick(preferred=wish((1, 10), (3, 30))) == {(1, 12), (2, 20), (3, 31)}  # mirrors and catalogs don't lead where another is
    plain = spark.createDataFrame([(10, "a", False), (11, "b", False), (12, "c", False)], "listing_id long, source_id string, is_active boolean")
    assert as_set(P.canonical_listings(photos.filter("vehicle_id = 1"), plain, preferred=wish((1, 11))), "canonical") == {(11,)}


def test_live_conditions(spark):
    rows = [(1, "BMW", "320i", 2010, 50_000.0, "2.0 L", "Diesel", 9000.0), (2, "BMW", "X5", None, None, None, None, None), (3, "Audi", "A4", 2015, 90_000.0, "1,998 cc", "Petrol", 20_000.0)]
    df = spark.createDataFrame(rows, "id long, make string, model string, year int, mileage double, engine_displacement string, fuel string, usd double")
    got = lambda **k: {r.id for r in df.filter(live_conditions(LiveSearch(**k), df.columns)).collect()}
    assert got() == {1, 2, 3} and got(year_from=2000) == {1, 3} and got(year_to=2012) == {1} and got(mileage_from=0) == {1, 2, 3} and got(mileage_to=60_000) == {1}
    assert got(engine_from=1990, engine_to=2000) == {1, 3} and got(engine_to=1999) == {3} and got(make="bm") == {1, 2} and got(texts={"fuel": "dies"}) == {1} and got(usd_to=10_000) == {1} and got(search="a4") == {3}


def test_near_vins_and_duplicates(spark):
    vins = [("A" * 16 + "B",), ("A" * 16 + "C",), ("B" + "A" * 15 + "B",), ("A" * 16 + "B",), ("short",)]
    got = as_set(J.near_vins(spark.createDataFrame(vins, "vin string")), "a", "b")
    assert got == {("A" * 16 + "B", "A" * 16 + "C"), ("A" * 16 + "B", "B" + "A" * 15 + "B")}


def test_cache_lives_against_a_loop(spark):
    logs = D.request_logs(spark, SF_DIR)
    got = {(r.path, r.began): (r.requests, r.hits) for r in L.cache_lives(logs, ["path"], "requested_at", "3 hours").collect()}
    want = {}
    for r in logs.collect():
        at = (r.path, r.requested_at.replace(hour=r.requested_at.hour // 3 * 3, minute=0, second=0, microsecond=0))
        want[at] = want.get(at, 0) + 1
    assert got == {k: (n, n - 1) for k, n in want.items()}


def test_shards_are_disjoint_and_bounded(spark):
    x = D.listings(spark, SF_DIR).select("price_amount").union(spark.range(900).select(F.lit(40).cast("long")))
    got = sorted((r.low, r.high, r.n) for r in L.range_shards(x, "price_amount", 500).collect())
    assert all(a[1] < b[0] for a, b in zip(got, got[1:])) and all(n <= 500 or low == high for low, high, n in got)
    assert sum(n for *_, n in got) == x.filter("price_amount IS NOT NULL").count()


def test_schedule(spark):
    for r in L.schedule(D.providers(spark, SF_DIR), "internal_name").collect():
        h = 0
        for ch in r.internal_name:
            h = (h * 31 + ord(ch)) % (1 << 32)
        g = 17
        for ch in r.internal_name + ":":
            g = (g * 31 + ord(ch)) % (1 << 32)
        assert r.repeat_hours == (4, 5, 6)[h % 3] and r.stagger_minutes == g % max(30, r.repeat_hours * 60 - 15)


def test_windows(spark):
    rows = spark.createDataFrame([(1, 1, None, "b"), (1, 2, "x", None), (1, 3, "y", "c"), (2, 1, None, None)], "k int, o int, a string, b string")
    assert as_set(W.merged_per_key(rows, ["k"], ["o"], ["a", "b"]), "k", "a", "b") == {(1, "x", "b"), (2, None, None)}
    assert as_set(W.resequenced(rows, "k", [F.col("o").desc()]), "k", "o", "sort_order", "is_primary") == {(1, 3, 0, True), (1, 2, 1, False), (1, 1, 2, False), (2, 1, 0, True)}
    hours = spark.range(1).select(F.size(W.buckets("2024-01-01 00:30:00", "2024-01-02 01:00:00", "hour")).alias("n")).first().n
    assert hours == 26


def test_registry_record(spark):
    raw = json.dumps({"firstDate": "20150304", "carInfoChanges": [{"date": "20180101", "carNo": "B"}, {"date": "20160101", "carNo": "A"}], "ownerChanges": ["2017-01-01"], "accidents": [{"date": "2019-01-01", "type": "2", "insuranceBenefit": 5}], "totalLossCnt": 0, "floodPartLossCnt": 1, "robberCnt": 1, "loan": "1", "notJoinDate1": "202001~202002"})
    got = record_events(spark.createDataFrame([(1, raw), (2, "broken"), (3, None)], "vehicle_id long, raw string"))
    assert {(r.event_type, r.description, r.occurred_at and str(r.occurred_at.date())) for r in got.collect()} == {
        ("delivery", "First registration: 20150304", "2015-03-04"), ("owner_change", "Owner change 1 of 3", "2016-01-01"), ("owner_change", "Owner change 2 of 3", "2017-01-01"), ("owner_change", "Owner change 3 of 3", "2018-01-01"),
        ("accident", "Own vehicle damage", "2019-01-01"), ("flood_damage", "Flood damage", None), ("other", "Theft: 1", None), ("other", "Loan use", None), ("other", "Insurance coverage gap: 202001~202002", None),
    }


@pytest.mark.parametrize("shape", ["listings", "vehicles", "bare"])
def test_json_import(spark, tmp_path, shape):
    one = {"provider": "p", "source_id": "1", "price": 5.0}
    data = {"listings": {"listings": [one | {"vin": "v1"}, {"vin": "v2"}]}, "vehicles": {"vehicles": [{"vin": "v1", "make": "M", "provider": "p", "listings": [one, {"price": 7.0}]}]}, "bare": [one | {"vin": "v1", "active": "No"}]}[shape]
    (tmp_path / "a.json").write_text(json.dumps(data))
    got = as_set(R.read_listings_json(spark, str(tmp_path)), "vin", "source_id", "price", "make", "active")
    assert got == {"listings": {("V1", "1", 5.0, None, True)}, "vehicles": {("V1", "1", 5.0, "M", True), ("V1", "import:V1", 7.0, "M", True)}, "bare": {("V1", "1", 5.0, None, False)}}[shape]


def test_csv_import_and_export(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿provider,vin,model,active\np,v1,"a ""b"", c\nd",no\n,v2,x,yes\n', encoding="utf-8")
    got = R.read_listings_csv(spark, str(tmp_path / "in.csv"))
    assert as_set(got, "vin", "provider", "model", "active", "source_id") == {("V1", "p", 'a "b", c\nd', False, "import:V1")}
    x = D.listings(spark, SF_DIR).limit(200).withColumns({"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")})
    out = K.export_rows(x, D.vehicles(spark, SF_DIR), D.providers(spark, SF_DIR))
    assert tuple(out.columns) == K.CSV_COLUMNS
    K.write_csv(out, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').count() == out.count()


def test_pages_and_references(spark):
    html = '<!DOCTYPE html><html lang="de"><title> A\n b </title><table><tr><th>Fuel</th><td><b>Diesel</b></td></tr><tr><td>Year</td><td>2015</td></tr></table><dl><dt>Color</dt><dd>red</dd></dl><a href="?page=2">2</a><a href="?page=14">x</a><script type="application/ld+json">{"a":1}</script></html>'
    df = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    row = {r.url: r for r in R.ADAPTERS["generic"](df).collect()}
    assert (row["u"].title, row["u"].lang, row["u"].last_page, row["u"].data, row["u"].is_page) == ("A b", "de", 14, '{"a":1}', True) and row["v"].is_page is False
    assert as_set(R.ADAPTERS["specs"](df), "name", "value") == {("Fuel", "Diesel"), ("Year", "2015"), ("Color", "red")}
    feed = spark.range(12).select((F.col("id") % 3).alias("page"), "id", F.col("id").alias("pos"), F.concat(F.lit("ref-"), "id").alias("source_id"))
    assert R.newest_refs(feed.union(feed)).count() == 12


def test_snapshots_and_appends(spark, tmp_path):
    df = spark.range(5)
    first, second = K.snapshot(df, str(tmp_path / "t"), 1), K.snapshot(df.limit(2), str(tmp_path / "t"), 2)
    assert spark.read.parquet(first).count() == 5 and spark.read.parquet(second).count() == 2
    K.append(df.withColumn("d", F.lit("x")), str(tmp_path / "a"), "d")
    K.append(df.withColumn("d", F.lit("y")), str(tmp_path / "a"), "d")
    assert spark.read.parquet(str(tmp_path / "a")).groupBy("d").count().count() == 2


def test_inspections_and_diagnoses(spark):
    from vinlake.operators.registry_records import diagnosis_events, inspection_events

    title = lambda t, s=None, *c: {"type": {"title": t}, "statusType": {"title": s} if s else None, "children": list(c)}
    report = {"recordNo": "R1", "issueDate": "20200102", "mileage": "60,000 km", "outers": [title("Hood ( )", "Scratch"), title("Doors", None, title("Front/left", "Replacement", title("Hinge", "Rust")))], "inners": [title("Frame", "Good"), {"type": {"title": "Pillar"}, "statusTypes": [{"title": "Welded"}]}]}
    got = inspection_events(spark.createDataFrame([(1, json.dumps(report)), (2, "broken"), (3, "{}")], "vehicle_id long, raw string")).withColumn("pos", F.lit(1))
    assert [(r.vehicle_id, str(r.occurred_at.date())) for r in got.collect()] == [(1, "2020-01-02")]
    assert as_set(H.body_panels(got, ["pos"]), "label", "legend") == {("Hood", "C"), ("Front left", "Z"), ("Hinge", "R"), ("Pillar", "W")}
    assert as_set(H.event_readings(got), "day", "km", "kind") == {("2020-01-02", 60000, "inspection")}
    items = [{"name": "HOOD", "resultCode": "NORMAL"}, {"partName": "DOOR", "resultCode": "REPLACEMENT", "result": "exchanged"}, {"name": "CHECKER_COMMENT", "result": "fine"}]
    out = diagnosis_events(spark.createDataFrame([(1, json.dumps({"items": items, "diagnosisDate": "2020-05-05"})), (2, json.dumps({"items": items[:1]})), (3, None)], "vehicle_id long, raw string")).withColumn("pos", F.lit(1))
    assert {(r.vehicle_id, json.loads(r.metadata)["allClear"]) for r in out.collect()} == {(1, False), (2, True)}
    assert as_set(H.body_panels(out, ["pos"]), "label", "legend") == {("DOOR", "Z")}


def replay(log):
    """One entry after the other: (status, failures, until, next page, fetched)."""
    s = ["pending", 0, None, 1, 0]
    for kind, until, n in log:
        if kind == "reset":
            s = ["pending", 0, None, 1, 0]
        elif s[0] == "completed":
            continue
        elif kind in ("page", "last"):
            s = ["pending" if kind == "page" else "completed", 0, None, s[3] + 1, s[4] + (n or 0)]
        elif kind == "failed":
            f = min(8, s[1] + 1)
            s = ["completed" if f >= 5 else "pending", f, None, s[3] + 1, s[4]]
        elif kind == "blocked":
            s = ["cooldown", min(8, s[1] + 1), until, s[3], s[4]]
    return s


@pytest.mark.parametrize("span_s", [1, 3600, 10**9])
def test_shard_states_equal_a_replay(spark, span_s):
    """Whatever the spans by which a log is composed, and the order of its rows."""
    rng, day, rows, want = random.Random(9), dt.datetime(2024, 1, 1), [], {}
    for shard in range(60):
        log = [(rng.choice(["page", "failed", "failed", "blocked", "blocked", "last", "reset", "noise"][: rng.randint(2, 8)]), day + dt.timedelta(hours=rng.randrange(60)), rng.choice([None, 0, 3])) for _ in range(rng.randrange(25))]
        rows += [(shard, day + dt.timedelta(minutes=i // 2 * 7) if i else None, i, *e) for i, e in enumerate(log)]
        if log:
            status, failures, until, page, fetched = replay(log)
            waits = status == "cooldown" and until > day + dt.timedelta(days=1)
            want[shard] = ("pending" if status == "cooldown" and not waits else status, failures, until if waits else None, page, fetched, failures >= 8 and fetched == 0)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "shard int, at timestamp_ntz, i int, kind string, until timestamp_ntz, n long").repartition(7)
    got = {r.shard: tuple(r)[1:] for r in S.shard_states(df, "shard", "at", ["i"], "2024-01-02 00:00:00", span_s).collect()}
    assert got == want
    assert S.shard_states(df.limit(0), "shard", "at", ["i"], "2024-01-02 00:00:00").count() == 0


def test_boxes_hold_every_row_once_and_keep_the_bound(spark):
    """Several columns, nulls, a value that fills most of a column, and rows that are equal in all columns."""
    rng = random.Random(10)
    rows = [(rng.choice([2001, 2002, None]), rng.choice(["a", "b", None, "ü/x"]), 7.0 if rng.random() < 0.6 else rng.choice([None, rng.random()]), rng.randrange(50)) for _ in range(3000)] + [(2005, "c", 1.0, 1)] * 90
    df = spark.createDataFrame(rows, "year int, make string, price double, km int")
    placed, boxes = S.box_shards(df, ["year", "make", "price", "km"], 40)
    assert placed.drop("box").exceptAll(df).count() == 0 and placed.count() == len(rows)
    said = {r.box: r for r in boxes.collect()}
    found = {}
    for r in placed.collect():
        found.setdefault(r.box, []).append((r.year, r.make, r.price, r.km))
    assert found.keys() == said.keys() and all(len(x) == said[b].n for b, x in found.items())
    assert all(len(x) <= 40 or len(set(x)) == 1 for x in found.values()) and max(map(len, found.values())) == 90
    for c in ("year", "price", "km"):
        i = ["year", "make", "price", "km"].index(c)
        assert all((said[b][f"low_{c}"], said[b][f"high_{c}"]) == (min((v[i] for v in x if v[i] is not None), default=None), max((v[i] for v in x if v[i] is not None), default=None)) for b, x in found.items())
    spans = sorted((said[b].low_year or 0, said[b].high_year or 0) for b in said)
    assert len(said) > 75 and spans[0] == (0, 0)
    none, empty = S.box_shards(df.limit(0), ["year", "price"], 5)
    assert none.count() == empty.count() == 0
    one, whole = S.box_shards(df, ["km"], 10_000)
    assert {r.box for r in whole.collect()} == {""} and one.count() == len(rows)


def test_pictures_of_lots_and_markets(spark):
    photos = spark.createDataFrame(
        [(1, "https://a.com/123456-1L.jpg"), (1, "https://a.com/654321-1.jpg"), (1, "https://b.com/x.jpg?partitionKey=123456"), (1, "https://b.com/r?imageKeys=999999~SID"), (1, ""), (1, None), (1, "data:image/gif;base64,xx"), (2, "https://a.com/654321-1.jpg"), (None, "https://a.com/654321-1.jpg"),
         (3, "https://kr.com/1.jpg"), (3, "https://us.com/1.jpg"), (3, "https://c.com/m/2020/777777/1.jpg"), (4, "https://kr.com/1.jpg"), (4, "https://c.com/1.jpg")],
        "listing_id long, source_url string",
    )
    listings = spark.createDataFrame([(1, "im-123456-9", None, "https://agg.com/1"), (2, "none", "kr", None), (3, None, None, "https://shop.com")], "listing_id long, source_id string, origin string, listing_url string")
    kept = {(r.listing_id, r.source_url) for r in P.of_listing_stock(photos, listings).collect()}
    gone = {(1, "https://a.com/654321-1.jpg"), (1, "https://b.com/r?imageKeys=999999~SID"), (1, ""), (1, None), (1, "data:image/gif;base64,xx")}
    assert kept == {tuple(r) for r in photos.collect()} - gone
    assert P.of_listing_stock(photos, listings, exempt="a[.]com").count() == len(kept) + 1
    us, kr = P.Market(("us",), "us[.]com", "us[.]com"), P.Market(("kr",), "kr[.]com", "mirror[.]com")
    own = {(r.listing_id, r.source_url) for r in P.of_own_market(photos, listings, us, kr).collect()}
    assert own == {tuple(r) for r in photos.collect()} - {(3, "https://kr.com/1.jpg")}
    assert P.of_verified_pages(photos, listings, "b[.]com", "agg[.]com").count() == photos.count() - 2
    for f in (lambda d: P.of_listing_stock(d, listings), lambda d: P.of_own_market(d, listings, us, kr), lambda d: P.of_verified_pages(d, listings, "b", "agg")):
        assert f(photos.limit(0)).count() == 0
