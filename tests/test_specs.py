"""Specification values, deep readings and public projections."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tests.test_functions import apply
from vinlake.functions import specs, walks
from vinlake.operators.projections import public, public_events


def test_specs(spark):
    assert apply(spark, specs.value, [" a  b ", "N/A", "--", "unknown", "", None, "Car", "carmine"]) == ["a b", None, None, None, None, None, None, "carmine"]
    assert apply(spark, specs.displacement, ["2.0 L", "0.0L", "0 CC", "-", "1998"]) == ["2.0 L", None, None, None, "1998"]
    assert apply(spark, lambda x: specs.english(x, specs.TRANSMISSIONS), ["Автомат", "механика", "Manual 5", "Цена автомат", "x" * 30, "Other", "Tiptronic", "магия"]) == ["Automatic", "Manual", "Manual", None, None, None, "Tiptronic", None]
    assert apply(spark, specs.chassis_code, ["[BMW] 5 Series (f10) 528i", "[MB] E-Class W213 E220d", "M3 2015", None]) == ["F10", "W213", None, None]
    assert apply(spark, specs.trim_after_code, ["[BMW] 5 Series (F10) - 528i xDrive", "E-Class W213", None]) == ["528i xDrive", None, None]
    rows = spark.createDataFrame([("2016 Mercedes-Benz GLE 350d 4Matic", 2016, "Mercedes-Benz", "GLE"), ("BMW X5 XDRIVE40i", None, "bmw", "X5"), ("2018 Kia Rio", 2018, "Kia", None), ("2018 -", 2018, None, None)], "t string, y int, m string, n string")
    got = [r.x for r in rows.select(specs.trim_remainder(F.col("t"), F.col("y"), F.col("m"), F.col("n")).alias("x")).collect()]
    assert got == ["350d 4Matic", "XDRIVE40i", "Rio", None]


def test_dictionary(spark):
    df = spark.createDataFrame([("Diesel ",), ("x",), (None,)], "a string")
    words = spark.createDataFrame([("diesel", "D"), ("DIESEL", "D"), (None, "?")], "word string, meaning string")
    for most in (10, 0):  # broadcast, and shuffled beyond the size
        assert sorted(str(r.a) for r in specs.translated(df, "a", words, most).collect()) == ["D", "None", "x"]


def test_deep_mileage(spark):
    deep = {"a": {"b": {"c": {"d": {"km": 5000}}}}}
    values = [json.dumps({"x": [{"odometer": {"value": "60,000 km"}}]}), json.dumps({"km": 1, "sub": {"miles": 700}}), json.dumps(deep), json.dumps({"z": deep}), "broken", None, "[]", json.dumps({"kmh": 9000}), json.dumps({"MILEAGE": "84,431 mi"})]
    assert apply(spark, walks.deep_mileage, values) == [60000.0, 700.0, 5000.0, None, None, None, None, None, 84431.0]


def test_salvage_order(spark):
    rows = [(500.0, '{"km": 9}', None, None, None), (1.0, '{"km": 900}', '{"km": 800}', None, None), (None, None, '{"km": 800}', "70,000 km", None), (None, "x", "x", "70,000 km", None), (None, None, None, "title", "<p>84,431 mi</p>")]
    df = spark.createDataFrame(rows, "s double, m string, p string, t string, h string")
    assert [r.x for r in df.select(walks.salvaged_mileage(*(F.col(c) for c in "smpth")).alias("x")).collect()] == [500.0, 900.0, 800.0, 70000.0, 84431.0]


def test_public(spark):
    df = spark.createDataFrame([(1, 2, "u", '{"source": "x", "km": 5}'), (1, 2, "u", '{"provider": "x"}'), (1, 2, "u", None)], "provider_id int, price int, source_url string, metadata string")
    assert public(df, "listing").columns == ["price", "metadata"]
    assert [r.metadata for r in public_events(df).collect()] == ['{"km":"5"}', None, None]
