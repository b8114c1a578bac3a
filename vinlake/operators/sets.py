"""Set operators and unions of unlike sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of the sources with the source's name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in sources.items()))


def distinct_union(*frames: DataFrame) -> DataFrame:
    """Rows of any of the frames, once."""
    return reduce(DataFrame.union, frames).distinct()


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose key b lacks (U5); null keys stay."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def gate(a: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose key all others hold."""
    return reduce(lambda x, y: x.join(y.select(*keys).distinct(), keys, "left_semi"), others, a)
