"""Exact percentiles and top lists in bounded memory: sketches and bucket counts narrow down what has to be looked at, exact counts decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.sources.writers import staged

#: Cuts of a round, the sketch's accuracy, and rows of a target that one task may sort in the end.
CUTS, ACCURACY, LAST = 200, 10_000, 1_000


def exact_percentile(df: DataFrame, by: Sequence[str], column: str, share: float, rounds: int = 40) -> DataFrame:
    """(by..., value): the exact percentile of a number, between ranks by linear interpolation, as `percentile` gives it (A5); null for a group without a number.

    `percentile` keeps all distinct values of a group in one task. Here each round takes cuts of the range that still holds the wanted rank from a mergeable sketch, counts
    exactly what is below and inside the two cuts around it, and goes on inside: some hundred times fewer rows a round, until one value or LAST rows are left. Groups of any
    size are summed up within tasks first. There is a row a group and rank between rounds."""
    if not by:  # all rows are one group
        return exact_percentile(df.withColumn("_all", F.lit(1)), ["_all"], column, share, rounds).select("value")
    x = df.select(*by, F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    groups = df.select(*by).distinct()
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    at = (F.col("n") - 1) * F.lit(share)
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)).cast("array<long>"))
    # below, n: rows of the group under the range and inside it; k: the wanted rank from 0 on.
    goal = staged(x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")).withColumn("all", F.col("n")).select("*", F.explode(ranks).alias("k"), F.lit(0).cast("long").alias("below")))
    for _ in range(rounds):
        open_ = goal.filter((F.col("low") < F.col("high")) & (F.col("n") > LAST))
        if open_.isEmpty():
            break
        inside = x.alias("x").join(open_.alias("g"), [*same("x", "g"), F.col("_x").between(F.col("low"), F.col("high"))]).select(*(F.col(f"g.{c}").alias(c) for c in by), "k", "low", "high", "below", "n", "_x")
        cuts = inside.groupBy(*by, "k", "low", "high", "below", "n").agg(F.percentile_approx("_x", [i / CUTS for i in range(CUTS + 1)], ACCURACY).alias("q"))
        place = F.floor((F.col("k") - F.col("below")) / F.col("n") * CUTS).cast("int")
        cuts = cuts.select(*by, "k", "low", "high", "below", "n", F.greatest("low", F.get("q", F.greatest(place - 1, F.lit(0)))).alias("a"), F.least("high", F.get("q", F.least(place + 2, F.lit(CUTS)))).alias("b"))
        counted = x.alias("x").join(staged(cuts).alias("g"), [*same("x", "g"), F.col("_x").between(F.col("low"), F.col("high"))]).select(*(F.col(f"g.{c}").alias(c) for c in by), "k", "low", "high", "below", "n", "a", "b", "_x")
        holds = F.col("_x").between(F.col("a"), F.col("b"))
        counted = counted.groupBy(*by, "k", "low", "high", "below", "n").agg(F.count_if(F.col("_x") < F.col("a")).alias("under"), F.count_if(holds).alias("m"), F.min(F.when(holds, F.col("_x"))).alias("a2"), F.max(F.when(holds, F.col("_x"))).alias("b2"))
        # The sketch may be off by more than it promises: then the range stays, less its ends.
        hit = (F.col("k") >= F.col("below") + F.col("under")) & (F.col("k") < F.col("below") + F.col("under") + F.col("m"))
        step = counted.select(*by, "k", F.when(hit, F.col("a2")).otherwise(F.col("low")).alias("low"), F.when(hit, F.col("b2")).otherwise(F.col("high")).alias("high"), F.when(hit, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"), F.when(hit, F.col("m")).otherwise(F.col("n")).alias("n"))
        closed = goal.filter(~((F.col("low") < F.col("high")) & (F.col("n") > LAST)))
        whole = closed.select(*by, "k", "low", "high", "below", "n", "all").unionByName(step.join(goal.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("k").alias("_k"), "all"), [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("k") == F.col("_k")]).select(*by, "k", "low", "high", "below", "n", "all"))
        goal = staged(whole)
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    few = goal.filter("low < high")
    values = x.alias("x").join(few.alias("g"), [*same("x", "g"), F.col("_x").between(F.col("low"), F.col("high"))]).select(*(F.col(f"g.{c}").alias(c) for c in by), "k", "below", "all", "_x")
    few = values.groupBy(*by, "k", "below", "all").agg(F.array_sort(F.collect_list("_x")).alias("v")).select(*by, "k", "all", F.get("v", (F.col("k") - F.col("below")).cast("int")).alias("v"))  # LAST rows at most
    found = goal.filter("low = high").select(*by, "k", "all", F.col("low").alias("v")).unionByName(few)
    part = (F.col("all") - 1) * F.lit(share) - F.floor((F.col("all") - 1) * F.lit(share))
    value = F.min_by("v", "k") + (F.max_by("v", "k") - F.min_by("v", "k")) * F.first(part)
    out = found.groupBy(*by).agg(value.alias("value"))
    return groups.alias("a").join(out.alias("b"), same("a", "b"), "left").select(*(F.col(f"a.{c}").alias(c) for c in by), "value")


def heavy_top(df: DataFrame, keys: Sequence[str], k: int, buckets: int = 1 << 16) -> DataFrame:
    """(keys..., n): the k most frequent keys with their exact counts, ties by key (O3), without a count of every key.

    Keys are counted by bucket of their hash first: a small mergeable table, and no key can be more frequent than its bucket. The keys of the fullest buckets are then counted
    exactly, which gives k counts to beat; only buckets that reach the k-th can hold another key of the list, and their keys are counted too. Where keys are flat that is all
    of them, and the result is exact all the same."""
    rows = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_b"))
    sizes = staged(rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_m")))
    exact = lambda some: rows.join(F.broadcast(some.select("_b")), "_b", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))  # noqa: E731  a row a bucket at most
    order = [F.col("n").desc(), *(F.col(c).asc_nulls_first() for c in keys)]
    fullest = sizes.orderBy(F.col("_m").desc(), "_b").limit(4 * k)
    first = staged(exact(fullest).orderBy(*order).limit(k))
    least = first.agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).first()
    other = sizes.join(F.broadcast(fullest.select("_b")), "_b", "left_anti")
    if least.n == k:
        other = other.filter(F.col("_m") >= least.least)
    other = staged(other)
    if other.isEmpty():
        return first
    return first.unionByName(exact(other)).orderBy(*order).limit(k)
