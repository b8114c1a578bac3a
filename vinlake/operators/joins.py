"""Joins: latest row per key, disjunctive counts, near identifiers, duplicate merges with re-pointed children, updates, upserts and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.functions.vin import hamming, wildcards
from vinlake.operators.windows import first_per_key


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in every column, null equal to null."""
    return reduce(Column.__and__, (left[n].eqNullSafe(right[n]) for n in names))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has max_rows rows at most (counted, stopping one row beyond); else as it is, to be shuffled. For tables whose size Spark overrates, as it
    does after joins."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_latest(parents: DataFrame, children: DataFrame, key: str, order: Sequence[Column | str], fields: dict[str, str]) -> DataFrame:
    """Parents with fields of their latest child (J8, J17); null where there is none. fields: child column to result column."""
    last = first_per_key(children, [key], order).select(key, *(F.col(a).alias(b) for a, b in fields.items()))
    return parents.join(last, key, "left")


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str, where: Column | None = None) -> DataFrame:
    """Parents with the number of their children, 0 for none (J9): counted first, then joined."""
    some = children if where is None else children.filter(where)
    return parents.join(some.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").na.fill(0, [name])


def either_key_count(parents: DataFrame, children: DataFrame, child_id: str, pairs: Sequence[tuple[str, str]], name: str, parent_id: str = "id") -> DataFrame:
    """Parents with the number of children that any of the key pairs (parent column, child column) ties to them (J10): an equi-join a pair, then distinct children."""
    hits = [parents.select(parent_id, F.col(a).alias("_k")).join(children.select(child_id, F.col(b).alias("_k")), "_k").select(parent_id, child_id) for a, b in pairs]
    n = reduce(DataFrame.union, hits).distinct().groupBy(parent_id).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, parent_id, "left").na.fill(0, [name])


def near_vins(df: DataFrame, vin: str = "vin") -> DataFrame:
    """(a, b): identifiers of 17 characters that differ in exactly one place, a < b (J12). They share a mask of that place, so an equi-join on masks finds them all. The
    join sorts: Spark's estimate doesn't count that each row becomes 17, and would broadcast them."""
    masks = df.filter(F.length(vin) == 17).select(F.col(vin).alias("v")).distinct().select("v", F.explode(wildcards(F.col("v"))).alias("mask"))
    pairs = masks.select("mask", F.col("v").alias("a")).join(masks.select("mask", F.col("v").alias("b")).hint("merge"), "mask").filter("a < b")
    return pairs.select("a", "b").filter(hamming(F.col("a"), F.col("b")) == 1)


def merge_duplicates(rows: DataFrame, keys: Sequence[str], rid: str = "id") -> DataFrame:
    """(id, keep): each row's id and the smallest id of the rows that agree with it in the keys, null equal to null."""
    keep = rows.groupBy(*keys).agg(F.min(rid).alias("keep"))
    return rows.join(keep, null_safe(rows, keep, keys)).select(rows[rid].alias("id"), "keep")


def repointed(children: DataFrame, mapping: DataFrame, foreign: str) -> DataFrame:
    """Children whose foreign key follows a mapping (id, keep); ids that it lacks stay."""
    return children.join(mapping.select(F.col("id").alias("_id"), "keep"), F.col(foreign) == F.col("_id"), "left").withColumn(foreign, F.coalesce("keep", foreign)).drop("_id", "keep")


def upserted(target: DataFrame, source: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The target after an upsert (K2): fields of the source where it has the key, also where they are null; new keys are added."""
    new = source.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_hit"))
    both = target.select(*keys, *fields).join(new, reduce(Column.__and__, (F.col(k) == F.col(f"_{k}") for k in keys)), "full")
    return both.select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), *(F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def updated_from(target: DataFrame, source: DataFrame, keys: Sequence[str], fields: Sequence[str], when: Column | None = None) -> DataFrame:
    """The target with fields replaced where the source (one row a key) has the key and `when`, over target columns and s_<field>, is true (K3)."""
    new = source.select(*(F.col(k) for k in keys), *(F.col(f).alias(f"s_{f}") for f in fields), F.lit(True).alias("_hit"))
    hit = F.col("_hit") if when is None else F.col("_hit") & when
    both = target.join(new, list(keys), "left").withColumn("_do", F.coalesce(hit, F.lit(False)))
    return both.withColumns({f: F.when(F.col("_do"), F.col(f"s_{f}")).otherwise(F.col(f)) for f in fields}).select(*target.columns)


def inserted_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The target and those rows of the source whose key it lacks, the first of each key (K1)."""
    fresh = first_per_key(source, keys, order).join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def purged(tables: dict[str, DataFrame], doomed: DataFrame, foreign: dict[str, str]) -> dict[str, DataFrame]:
    """The tables without the rows of doomed keys (K4, K11). foreign: table to the column that holds the key; doomed: one column."""
    key = doomed.columns[0]
    return {name: t.join(doomed.select(F.col(key).alias("_k")), F.col(foreign[name]) == F.col("_k"), "left_anti") for name, t in tables.items()}


def synced(target: DataFrame, source: DataFrame, key: str, rid: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of the source that the target lacks, mapping (source id, target id) of those that both have): for copies between databases."""
    missing = source.join(target.select(key), key, "left_anti")
    mapping = source.select(F.col(key), F.col(rid).alias("source_id")).join(target.select(F.col(key), F.col(rid).alias("target_id")), key).select("source_id", "target_id")
    return missing, mapping
