"""Readings deep in JSON trees of unknown shape. Which path holds one isn't known before, so this walk is Python, over Arrow batches, and only for rows that nothing else served."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vinlake.functions import mileage as M

# Fixed values.
KEYS = re.compile(r"^(?:odometer|odo|mileage|mileages|km|kilometers|kilometres|miles|driveDistance|drive_distance|odometerValue|odometer_value|mileageFromOdometer|주행거리)$", re.I)
DEPTH, NODES, ITEMS, HEAD = 4, 80, 20, 120_000
_FORMS = [re.compile(x) for x in M.TEXT_FORMS]


def _usable(x: float) -> bool:
    return M.LEAST < x <= M.MOST


def _reading(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v) if _usable(v) else None
    if isinstance(v, str):
        for form in _FORMS:
            if (m := form.search(v)) and _usable(x := float(m[1].replace(",", ""))):
                return x
        digits = re.sub(r"[^\d.]", "", v)
        try:
            return float(round(x)) if _usable(x := float(digits)) else None
        except ValueError:
            return None
    if isinstance(v, dict):
        return next((x for k in ("value", "amount", "km", "miles", "odometer", "mileage") if (x := _reading(v.get(k))) is not None), None)
    return None


def _walk(node: object, depth: int, seen: list[int]) -> float | None:
    if depth > DEPTH or seen[0] > NODES:
        return None
    seen[0] += 1
    if isinstance(node, dict):
        for k, v in node.items():
            if KEYS.match(k) and (x := _reading(v)) is not None:
                return x
    below = node[:ITEMS] if isinstance(node, list) else node.values() if isinstance(node, dict) else ()
    return next((x for v in below if isinstance(v, (dict, list)) and (x := _walk(v, depth + 1, seen)) is not None), None)


def _of_text(raw: str | None) -> float | None:
    try:
        return _walk(json.loads(raw), 0, [0]) if raw else None
    except (ValueError, RecursionError):
        return None


def deep_mileage(raw: Column) -> Column:
    """The first usable reading under a known name, at most DEPTH levels down and after NODES nodes at most; null for broken JSON."""

    @F.pandas_udf("double")
    def walk(values: pd.Series) -> pd.Series:
        return pd.Series([_of_text(v) for v in values], dtype="float64")

    return F.nullif(F.nanvl(walk(raw), F.lit(None).cast("double")), F.lit(float("nan")))


def salvaged_mileage(stated: Column, metadata: Column, payload: Column, title: Column, html: Column) -> Column:
    """A listing's reading (E32): its own, from metadata, from the payload's tree, from the title, from the page's beginning."""
    return F.coalesce(F.when(M.usable(stated), stated.cast("double")), deep_mileage(F.when(~M.usable(stated), metadata)), deep_mileage(F.when(~M.usable(stated), payload)), M.in_text(title), M.in_text(F.substring(html, 1, HEAD)))
