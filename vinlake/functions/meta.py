"""Metadata that is kept as JSON text. Broken JSON and other values than objects count as empty.

A text is parsed once, into a map, or into a struct where the fields that can be asked for are known; the getters take either. Keep it as a column of its own where
several fields are read: Spark then doesn't parse again for each. A struct's field is found by its place, a map's by comparing its keys one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions.numbers import plain_number


def parsed(raw: Column) -> Column:
    """The object as a map from field to text; numbers and nested values as they are written. Null for broken JSON and anything but an object."""
    return F.from_json(raw, "map<string,string>")


def fields(raw: Column, names: Sequence[str]) -> Column:
    """The object as a struct of these fields, texts as in the map; null where it has none. Of a field that the text repeats the last counts, as it does in JavaScript."""
    # With an option named, Spark doesn't split the parse into one for each field that is read. A text that is made by an expression is asked for twice, so that it is a
    # column first: within the parse it would be computed without generated code.
    return F.when(F.contains(raw, F.lit("{")), F.from_json(raw, ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE"}))


def field(m: Column, name: str) -> Column:
    return m[name]


def text(m: Column, *names: str) -> Column:
    """The first of the fields that holds more than white space, without it at the ends."""
    return F.coalesce(*(F.nullif(F.btrim(field(m, n), F.lit(" \t\n\r\u00a0")), F.lit("")) for n in names))


def number(m: Column, *names: str) -> Column:
    """The first of the fields that holds a number, or a text that is one."""
    return F.coalesce(*(plain_number(field(m, n)) for n in names))


def loose_number(m: Column, *names: str) -> Column:
    """The first of the fields with a number once all but digits and points is left out: "60,000 km" is one."""
    return F.coalesce(*(F.when(field(m, n).rlike("[0-9]"), F.regexp_replace(field(m, n), r"[^\d.]", "").try_cast("double")) for n in names))


def flag(m: Column, name: str) -> Column:
    """true or false; null where the field holds anything else."""
    x = field(m, name)
    return F.when(x == "true", True).when(x == "false", False)


def with_fields(raw: Column, fields: Column) -> Column:
    """The JSON object with more fields (a map of texts); a field of the same name is replaced. Numbers and nested values of the object become text."""
    old = F.coalesce(parsed(raw), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(fields), k)), fields))


def without(raw: Column, *names: str) -> Column:
    """The JSON object without internal fields."""
    return F.to_json(F.map_filter(parsed(raw), lambda k, _: ~k.isin(*names)))


def kind(raw: Column, name: str) -> Column:
    """What a field of the JSON text is: STRING, BOOLEAN, BIGINT, OBJECT and so on; null if it isn't there. The map holds all as text and can't tell."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "variant"))
