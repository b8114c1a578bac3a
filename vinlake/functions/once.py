"""Values that an expression takes several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value bound by an array of one: Spark would write it out wherever `of` takes it, and compute it for each."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
