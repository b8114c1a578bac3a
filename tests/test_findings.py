"""What a reviewer found on larger and odd tables, on small ones of the same kind."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR, TABLES, duck_over
from tests.test_oracle import same_rows
from vinlake.functions import text
from vinlake.functions import urls as U
from vinlake.functions.labels import title_parts
from vinlake.functions.phrases import Phrases
from vinlake.operators import history as H
from vinlake.operators import joins as J
from vinlake.operators import photos as P
from vinlake.operators import shards as S
from vinlake.plans import QUERIES, streams
from vinlake.sources import domain as D
from vinlake.sources import writers as W
from vinlake.streaming import merging as M


def tables_with(folder: Path, **changed) -> str:
    """A folder of the tables in which some are others."""
    for t in TABLES:
        if t in changed:
            changed[t].write.parquet(str(folder / f"{t}.parquet"))
        else:
            (folder / f"{t}.parquet").symlink_to(Path(SF_DIR, f"{t}.parquet"))
    return str(folder)


def test_masks_are_not_broadcast(spark):
    pairs = J.near_vins(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 17, "A").alias("vin")))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ingest_gates", "vin_quality"])
def test_identifiers_of_digits_alone(spark, tmp_path, name):
    """The digest of 4850 begins with 17 digits."""
    part, lineitem = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("part", "lineitem"))
    first = part.agg(F.min("p_partkey")).first()[0]
    sf_dir = tables_with(tmp_path, part=part.withColumn("p_partkey", F.col("p_partkey") - first + 4850), lineitem=lineitem.withColumn("l_partkey", F.col("l_partkey") - first + 4850))
    assert same_rows(spark, duck_over(sf_dir), name, sf_dir) > 0


@pytest.mark.parametrize("name", ["stream_daily_limits", "stream_throttle", "stream_sessions"])
def test_streams_over_many_files(spark, tmp_path, name):
    """Files of a span hold its rows in no order of time. Ten clients, so that each has many requests."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("user_id", F.col("user_id") % 10).repartition(9, "event_id")
    sf_dir = tables_with(tmp_path, events=events)
    # A file a task, however small the files are.
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        assert same_rows(spark, duck_over(sf_dir), name, sf_dir) > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_title_is_taken_apart_once(spark):
    makes = [f"Brand#{i}" for i in range(1, 26)]
    rows = spark.createDataFrame([("2011 Brand#12 used 5er clean title",), ("Brand#1",), ("BRAND#2 X5 1999",), ("Brand#123 X",), (None,)], "title string")
    got = rows.select("title", *(c.alias(n) for n, c in zip(("year", "make", "model"), title_parts(F.col("title"), makes))))
    assert [tuple(r)[1:] for r in got.collect()] == [(2011, "Brand#12", "5er"), (None, "Brand#1", None), (1999, "Brand#2", "X5"), (None, None, None), (None, None, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 30


def test_buckets_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """A bucket of many rows is no one task's work."""
    monkeypatch.setattr(M, "PIECE", 100, raising=False)
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    merge = lambda df: df.groupBy("k").agg(F.max("n").alias("n"))
    for number in range(2):
        M.merge_batch(rows, number, str(tmp_path / "t"), ["k"], merge, buckets=2)
        for bucket in range(2):
            assert len(list((tmp_path / "t" / f"bucket={bucket}" / f"batch={number}").glob("*.parquet"))) > 4
    assert M.current(spark, str(tmp_path / "t"), rows.schema).count() == 3000


def test_cuts_of_a_box_are_found_once(spark, monkeypatch):
    """Not for each of its rows, and a level writes a row once."""
    plans, write = [], S.staged
    monkeypatch.setattr(S, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    df = spark.range(3000).select((F.col("id") % 70).alias("a"), F.concat(F.lit("t"), F.col("id") % 3).alias("b"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("c"))
    rows, boxes = S.box_shards(df, ["a", "b", "c"], 100)
    assert not [p for p in plans if "array_union" in p and "concat_ws" in p]
    assert rows.count() == 3000 and boxes.agg(F.sum("n")).first()[0] == 3000
    assert boxes.filter("n > 100 AND splittable").isEmpty()
    counts = rows.groupBy("box").agg(F.count(F.lit(1)).alias("m")).join(boxes, "box", "full")
    assert counts.filter("NOT n <=> m").isEmpty()


def test_kind_of_a_field_is_asked_where_it_holds_something(spark):
    events = spark.createDataFrame([(1, "other", None, "{}", 1), (2, "other", None, '{"salvage":true}', 1)], "vehicle_id int, event_type string, description string, metadata string, line int")
    got = H.salvage_records(events.withColumn("occurred_at", F.lit("2020-01-01").cast("timestamp_ntz")), ["occurred_at", "line"])
    assert [r.vehicle_id for r in got.collect()] == [2]
    plan = got._jdf.queryExecution().analyzed().toString()
    asked = "schema_of_variant"
    assert plan.count(asked) == len(re.findall(rf"isnotnull\(try_element_at\(_m#\d+, \w+\)\) THEN {asked}", plan)) > 0


def test_phrases_in_json_without_reading_each_value(spark):
    d = Phrases({"a": 'q"', "ab": "x\ty", "é": "\x01", "b": "", "true": "no", '"': "z"})
    cases = {
        '{"a":"cab","n":1,"t":true}': '{"a":"cx\\ty","n":1,"t":true}', '{"k":["a","é",{"a" : "c"}]}': '{"k":["q\\"","\\u0001",{"a" : "c"}]}', '{"k":"c\\"a\\u00e9"}': '{"k":"czq\\"\\u0001"}',
        '{"k":"true","b":""}': '{"k":"no","b":""}', '{"k":"b"}': '{"k":""}', '{"k":"a"': '{"k":"a"', "cc": "cc", "": "", '{"k":"\\u00fc"}': '{"k":"ü"}',
    }
    out = d.replaced_in_json(F.col("raw"))
    got = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string").select("raw", out.alias("out"))
    assert {r.raw: r.out for r in got.collect()} == cases | {None: None}
    words = Phrases({"ab": "x"}, whole_words=True)
    rows = spark.createDataFrame([('{"ab":"ab abc","k":"cab"}',), ('{"k":"ab"}',)], "raw string").select(words.replaced_in_json(F.col("raw")).alias("out"))
    assert [r.out for r in rows.collect()] == ['{"ab":"x abc","k":"cab"}', '{"k":"x"}']
    assert "rlike" in got._jdf.queryExecution().analyzed().toString().lower()


def test_documents_are_cut_up_once(spark):
    assert QUERIES["phrases_in_documents"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_metadata_is_not_read_again_in_a_join(spark):
    plan = QUERIES["auction_sales"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"\bJoin \w+", line)]
    assert joins and not [line for line in joins if "json" in line.lower()]


def test_identifiers_are_computed_once_and_not_for_each_listing(spark):
    """A filter on the identifier, which follows from the key, was inferred for listings and photos, and the digest stood in it for each place of the check digit."""
    plan = QUERIES["recent_hints"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_frames_without_stills_in_one_pass(spark):
    rows = [(1, 1, "gallery"), (1, 1, "exterior_3d"), (1, 2, "exterior_3d"), (1, None, "gallery"), (1, None, "exterior_3d"), (None, 1, "gallery"), (None, 1, "interior"), (1, 1, None), (2, 1, "interior"), (1, 1, "interior")]
    photos = spark.createDataFrame(rows, "vehicle_id int, listing_id int, photo_group string")
    got = [tuple(r) for r in P.without_orphan_frames(photos).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, "gallery"), (1, 1, "exterior_3d"), (1, 1, "interior"), (1, None, "gallery"), (None, 1, "gallery")], key=repr)
    assert QUERIES["photo_filters"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_labels_are_not_found_for_each_listing(spark):
    """The filter on a vehicle's fuel, which follows from the key, was inferred for listings."""
    plan = QUERIES["vehicle_page"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    fuels = [line for line in plan.splitlines() if "phev" in line]
    assert fuels and not [line for line in fuels if "l_partkey" in line]


def test_exports_are_not_shuffled_for_providers(spark):
    """Spark overrates providers, three tables joined, and shuffled the wide rows of listings and vehicles for them."""
    rows = W.export_rows(D.listings(spark, SF_DIR).withColumns({"first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")}), D.vehicles(spark, SF_DIR), D.providers(spark, SF_DIR))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(provider_id" not in plan


ODD_METADATA = (
    '{"date":"2020-01-02","mileageKm":900,"value":null,"panels":["a: b",{"x":1}],"sticky":true}', '{"odometer":"12,000 mi","km":1.50,"unknown":{"a":[1]}}', "{}", "", "null", "[1]", '[{"date":"x"}]', "{broken", '{"date":"x","km":', '"text"', "12", None,
    ' {"date":" \\u00a0x ","type":""}', '{"Date":"upper","source":"s{}"}',
)


def test_metadata_is_a_struct_that_says_what_the_map_says(spark):
    rows = H.with_meta(spark.createDataFrame([(t,) for t in ODD_METADATA], "metadata string"))
    assert rows.schema["_m"].dataType.typeName() == "struct"
    m, same = F.from_json("metadata", "map<string,string>"), [F.col("_m")[n].eqNullSafe(F.try_element_at("m", F.lit(n))) for n in H.FIELDS]
    assert rows.withColumn("m", m).select(F.array(*same).alias("same")).filter(F.exists("same", lambda x: ~x)).count() == 0


def test_identity_and_salvage_of_texts(spark):
    """Texts that take the short way read as those that take the long one."""
    long = lambda x: text.tidy(F.regexp_replace(F.lower(x), r"[()\[\]{},.;:!?|/\\]+", " "))
    texts = spark.createDataFrame([(t,) for t in ("", " ", "Oil,  change /  filter.", "(a) b; c", "\tInspection done\n", "전손: x", None)], "d string")
    assert texts.filter(~text.same_day_text(F.col("d")).eqNullSafe(long(F.col("d")))).count() == 0
    said = spark.createDataFrame([(t,) for t in ("parts  only", "Certificate\nof destruction", "JUNK", "ſalvage", "total  loss: 0", "a cod b", "codfish", "전손", "total", None)], "d string")
    assert [r.s for r in said.select(text.salvage(F.col("d")).alias("s")).collect()] == [True, True, True, True, False, True, False, True, False, False]


def test_histories_take_one_shuffle(spark):
    readings = spark.range(9).select(
        (F.col("id") % 2).alias("vehicle_id"), F.lit("2020-01-0").alias("day"), (F.col("id") * 100).alias("km"), F.lit("listing").alias("kind"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(False).alias("of_event")
    )
    plan = H.mileage_history(readings)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_one_sort_serves_the_windows_of_a_group(spark):
    events = D.events(spark, SF_DIR).filter("event_type = 'inspection'")
    plan = H.timeline(events, ["order_id", "line", "provider_id", "metadata"])._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert len(re.findall(r"Sort \[vehicle_id#\S+ ASC NULLS FIRST, _g#", plan)) == 1


def test_observations_of_a_stream_without_state(spark, tmp_path, monkeypatch):
    """The sink compares with the history; state held each content of a span in memory. Contents that repeat within a span and across spans, and null ones, count once."""
    folders = []
    monkeypatch.setattr(streams, "scratch", lambda s: folders.append(str(tmp_path / f"s{len(folders)}")) or folders[-1])
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").filter("l_orderkey % 10 = 0")
    at = [F.lit(d).cast("timestamp_ntz") for d in ("1995-05-05", "1996-06-06", "1998-08-08", "2000-01-01")]
    again = lineitem.withColumn("l_shipdate", F.explode(F.array(*at))).withColumn("l_tax", F.when(F.col("l_linenumber") > 2, 0.09).otherwise(F.col("l_tax")))
    sf_dir = tables_with(tmp_path, lineitem=lineitem.unionByName(again.select(lineitem.columns)))
    assert same_rows(spark, duck_over(sf_dir), "stream_observations", sf_dir) > 0
    assert len(folders) == 3 and not [f for f in folders if Path(f, "state").exists()]


def test_sums_of_a_report_are_those_of_its_sections(spark):
    """Without nesting the rows. Distances in plateaus, repeats, null sources, kinds and days."""
    cases = [(v, d and f"2020-01-{d:02}", km, kind, source, kind != "listing") for v in (1, 2, None) for d in (1, 1, 2, 3, 5, 8, None) for km in (0, 500, 900) for kind, source in (("listing", f"s{d}"), ("listing", None), ("sale", "b")) if d != v]
    readings = spark.createDataFrame(cases + [(3, "2020-02-02", 7, None, None, True), (4, None, 7, "sale", "x", True)], "vehicle_id int, day string, km long, kind string, source string, of_event boolean")
    history = H.mileage_history(readings)
    whole = history.groupBy("vehicle_id").agg(F.count("*"), F.max_by("km", "latest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))), F.count_if(~F.col("of_event")))
    assert sorted(map(tuple, H.mileage_sums(readings).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    vehicles = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "id int, vin string")
    sections = {"a": readings.select("vehicle_id", "km"), "b": readings.filter("vehicle_id = 2").select("vehicle_id", (F.col("km") > 500).alias("far")), "c": readings.filter("km < 0")}
    full = H.report(vehicles, sections).select("id", "vin", *(F.coalesce(F.size(n), F.lit(0)).alias(n) for n in sections), F.exists("b", lambda x: x["far"]).alias("far"))
    got = H.report_sums(vehicles, sections, far=F.bool_or("far"))
    assert got.columns == full.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    plan = QUERIES["vehicle_reports"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(mileage" not in plan and "collect_list(timeline" not in plan


def test_timelines_take_one_shuffle(spark):
    plan = H.timeline(D.events(spark, SF_DIR), ["order_id", "line", "provider_id", "metadata"])._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(vehicle_id") == 1


def test_texts_without_a_signal_are_not_parsed(spark):
    """Names of fields may be escaped; a description alone may be the signal."""
    rows = [
        ("other", None, '{"\\u0073alvage":true}'), ("other", None, "{'salvage':true}"), ("total_loss", None, None), (None, " Title: Junk", None), ("other", "JUNK", ""), ("other", None, '{"damageClass":"junk"}'),
        ("Flood_Damage", None, '{"floodTotalLossCnt":1}'), ("other", None, '{"f\\u0069eld":"title","v\\u0061lue":"Clear"}'), ("sale", "Sold", '{"title":"junk"}'), (None, None, None),
    ]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vehicle_id int, event_type string, description string, metadata string").withColumn("occurred_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    got = H.salvage_records(events, ["occurred_at"])
    assert {r.vehicle_id: r.salvage for r in got.collect()} == {0: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}
    assert {r.vehicle_id: r.salvage for r in H.salvage_records(events, ["occurred_at"], always="nothing").collect()} == {0: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}
    assert "RLIKE(metadata" in got._jdf.queryExecution().analyzed().toString()


def test_junk_pictures_are_searched_for_words_first(spark):
    """The pattern is tried only where a part of each address that it fits is there, in any case."""
    pattern = r"(?i)^data:|(?:^|[/_.-])(?:logo|icon|sprite|placeholder|no[-_]?(?:image|photo)|blank|pixel|avatar|banner)(?:[/_.-]|$)|\.(?:svg|gif)(?:\?|$)"
    urls = ("", "DATA:x", "a/data:x", "Logo", "x/LOGO.png", "x/logos/1.jpg", "a_icon-b", "sprite", "my.placeholder", "NoImage", "no-photo.jpg", "nophotos", "a/no_image/", "blank", "pixel.", "-Avatar_", "banner", "x.SVG", "x.svg?y", "x.gifs", "İcon", "/İcon/", "x.gıf", "https://a.b/1.jpg", None)
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.junk_picture(F.col("u")).alias("junk"), F.coalesce(F.col("u").rlike(pattern), F.lit(True)).alias("want"))
    assert rows.filter(~F.col("junk").eqNullSafe(F.col("want"))).count() == 0 and rows.filter("junk").count() > 12
    plan = rows.select("junk")._jdf.queryExecution().analyzed().toString()
    assert "Contains(" in plan
