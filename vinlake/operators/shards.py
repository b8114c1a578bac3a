"""Shards of a crawl: their states as a composition of transitions, and the cutting of a table into boxes over several columns.

A log entry is a function from state to state. Functions compose associatively, so a shard's log is cut into spans of time, each span is composed by itself wherever its
rows are, and only the spans' functions meet: no task needs a shard's whole log, and entries may come in any order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.session import scratch
from vinlake.sources.writers import staged

# Failed pages in a row that end a shard, and failures from which a shard that has given nothing is chronic.
MOST_FAILURES, CHRONIC = 5, 8
_ENTRY = "struct<status:string,failures:int,until:timestamp_ntz,pages:bigint,fetched:bigint,reset:boolean>"
#: The place of the state "completed" in a function's table; the places before it are the numbers of failures, CHRONIC and more as one.
_DONE = CHRONIC + 1


def _entry(status, failures, until, pages, fetched, reset) -> Column:
    return F.struct(status.alias("status"), failures.cast("int").alias("failures"), until.alias("until"), pages.cast("long").alias("pages"), fetched.cast("long").alias("fetched"), reset.alias("reset"))


def _identity() -> Column:
    """The function that changes nothing, as a table: what becomes of a shard that comes with 0, 1, ... failures, or completed. A null status is the one it came with."""
    none = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    rows = [_entry(F.lit("completed") if k == _DONE else none[0], F.lit(min(k, CHRONIC)), none[1], F.lit(0), F.lit(0), F.lit(False)) for k in range(_DONE + 1)]
    return F.array(*rows).cast(f"array<{_ENTRY}>")


def _after(s: Column, e: Column) -> Column:
    """A state after one log entry (kind, until, n): what a page, a failed page, a block and a reset do; a completed shard only heeds a reset."""
    no_time, fails = F.lit(None).cast("timestamp_ntz"), F.least(s["failures"] + 1, F.lit(CHRONIC))
    page = lambda status: _entry(status, F.lit(0), no_time, s["pages"] + 1, s["fetched"] + e["n"], s["reset"])
    failed = _entry(F.when(fails >= MOST_FAILURES, "completed").otherwise("pending"), fails, no_time, s["pages"] + 1, s["fetched"], s["reset"])
    blocked = _entry(F.lit("cooldown"), fails, e["until"], s["pages"], s["fetched"], s["reset"])
    fresh = _entry(F.lit("pending"), F.lit(0), no_time, F.lit(0), F.lit(0), F.lit(True))
    live = F.when(e["kind"] == "page", page(F.lit("pending"))).when(e["kind"] == "last", page(F.lit("completed"))).when(e["kind"] == "failed", failed).when(e["kind"] == "blocked", blocked).otherwise(s)
    return F.when(e["kind"] == "reset", fresh).when(F.coalesce(s["status"] == "completed", F.lit(False)), s).otherwise(live)


def _composed(first: Column, second: Column) -> Column:
    """The function that does the first and then the second: the second's row for the state in which the first ends."""

    def then(a: Column) -> Column:
        b = F.get(second, F.when(F.coalesce(a["status"] == "completed", F.lit(False)), _DONE).otherwise(a["failures"]))
        both = _entry(F.coalesce(b["status"], a["status"]), b["failures"], F.when(b["status"].isNull(), a["until"]).otherwise(b["until"]), a["pages"] + b["pages"], a["fetched"] + b["fetched"], a["reset"])
        return F.when(b["reset"], b).when(F.coalesce(a["status"] == "completed", F.lit(False)), a).otherwise(both)

    return F.transform(first, then)


def shard_states(log: DataFrame, shard: str, at: str, order: Sequence[str], as_of: str, span_s: int = 86_400) -> DataFrame:
    """(shard, status, failures, wakes_at, next_page, fetched, chronic) of each shard after its log (T10), by composed transitions.

    log: the shard, `at`, kind, until, n and the columns of `order` that settle ties. kind: page (n listings, and more to come), last (n listings, no more), failed (a page
    that can't be read: five in a row end the shard), blocked (until), reset. A cooldown that has ended by as_of is pending. Entries of other kinds change nothing; a null
    n counts as 0, and an entry without a time comes first. `failures` counts to 8. chronic: 8 failures and nothing fetched."""
    rows = log.select(shard, F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (span_s * 1_000_000)).alias("slot"), F.struct(F.col(at).alias("at"), *order, "kind", F.col("until").cast("timestamp_ntz").alias("until"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).alias("e"))
    spans = rows.groupBy(shard, "slot").agg(F.array_sort(F.collect_list("e")).alias("es"))
    spans = spans.select(shard, "slot", F.aggregate("es", _identity(), lambda f, e: F.transform(f, lambda s: _after(s, e).cast(_ENTRY))).alias("f"))
    whole = spans.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct("slot", "f"))).alias("fs"))
    end = F.get(F.aggregate("fs", _identity(), lambda f, x: _composed(f, x["f"]).cast(f"array<{_ENTRY}>")), F.lit(0))
    out, now = whole.select(shard, end.alias("s")), F.lit(as_of).cast("timestamp_ntz")
    waits = (F.col("s.status") == "cooldown") & (F.col("s.until") > now)
    status = F.when(F.col("s.status") == "cooldown", F.when(waits, "cooldown").otherwise("pending")).otherwise(F.coalesce("s.status", F.lit("pending")))
    return out.select(
        shard, status.alias("status"), F.col("s.failures").alias("failures"), F.when(waits, F.col("s.until")).alias("wakes_at"), (F.col("s.pages") + 1).alias("next_page"), F.col("s.fetched").alias("fetched"),
        ((F.col("s.failures") >= CHRONIC) & (F.col("s.fetched") == 0)).alias("chronic"),
    )


#: Quantiles that a box is cut at most at once.
CUTS = 32


def box_shards(df: DataFrame, columns: Sequence[str], most: int, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, boxes): df with its box, and (box, n, low_<column>, high_<column>, splittable) of each box (T11): boxes over several columns with at most `most` rows each,
    unless all rows of a box are equal in all columns.

    A tree, level by level: each box with too many rows is cut along the first of `columns` in which its rows differ, texts by value and numbers at approximate quantiles; a
    number that fills quantiles by itself gets a box of its own. A level takes one aggregation by box, with partial sums in the tasks, and two joins of the rows with the
    boxes to cut, of which there are at most rows / most: one for the quantiles and one for the pieces, which writes each row once. Rows of finished boxes stay where the
    level after wrote them. Boxes are disjoint and hold every row once; a null is a value of its own, below all others. Numbers are compared as doubles."""
    kinds, spark = dict(df.dtypes), df.sparkSession
    text = {c: kinds[c] == "string" for c in columns}
    same = lambda x, c: F.col(x) if text[c] else F.col(x).cast("double")
    blank, hashed = F.array().cast("array<string>"), F.xxhash64("box").alias("_h")  # the hash goes before the box in every key, so that sorts compare numbers
    rows, done, done_sizes, numbers = df.withColumn("box", blank).select("*", hashed), [], scratch(spark), [c for c in columns if not text[c]]
    for _ in range(rounds):
        facts = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))] + [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
        differ = {c: (same(f"low_{c}", c) != same(f"high_{c}", c)) | ((F.col(f"nulls_{c}") > 0) & (F.col(f"nulls_{c}") < F.col("n"))) for c in columns}
        along = F.coalesce(*(F.when(F.coalesce(differ[c], F.lit(False)), F.lit(c)) for c in columns))
        sizes = staged(rows.groupBy("_h", "box").agg(F.count(F.lit(1)).alias("n"), *facts).withColumn("along", along))
        to_cut = (F.col("n") > most) & F.col("along").isNotNull()
        cut = sizes.filter(to_cut).select(F.col("_h").alias("_h2"), F.col("box").alias("_b"), F.col("n").alias("_n"), "along")
        sizes.filter(~to_cut).drop("_h").write.mode("append").parquet(done_sizes)
        if cut.isEmpty():
            break
        mine = (F.col("_h") == F.col("_h2")) & (F.col("box") == F.col("_b"))
        value = F.coalesce(*(F.when(F.col("along") == c, F.col(c).cast("double")) for c in numbers)) if numbers else F.lit(None).cast("double")
        quantiles = F.percentile_approx("_v", [k / CUTS for k in range(1, CUTS)], 1000)
        values = rows.join(cut, mine).select("_h2", "_b", "_n", value.alias("_v")).filter("_v IS NOT NULL")
        ranges = values.groupBy("_h2", "_b", "_n").agg(quantiles.alias("_q"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        # Written, so that cuts are found once a box and not once a row.
        cut = staged(cut.join(_with_cuts(ranges, most).select("_h2", "_b", "_cuts", "_heavy"), ["_h2", "_b"], "left"))
        texts = F.coalesce(*(F.when(F.col("along") == c, F.concat(F.lit("'"), c)) for c in columns if text[c]), F.lit(None).cast("string"))
        piece = F.coalesce(texts, _number_piece(value), F.lit("null"))
        inner = F.when(F.col("_b").isNotNull(), F.concat("box", F.array(F.concat_ws("=", "along", piece)))).otherwise(F.col("box"))
        level = rows.join(cut, mine, "left").select(*df.columns, inner.alias("box"), F.col("_b").isNotNull().alias("_go")).select("*", hashed)
        level = staged(level)  # lineage ends here, so a lost executor costs one level
        done.append(level.filter("NOT _go").drop("_go", "_h"))
        rows = level.filter("_go").drop("_go")
    else:
        raise RuntimeError(f"boxes did not settle in {rounds} levels")
    whole = reduce(DataFrame.unionByName, done, rows.drop("_h"))
    boxes = spark.read.parquet(done_sizes).withColumn("box", F.array_join("box", "/"))
    boxes = boxes.select("box", "n", *(f"{n}_{c}" for c in columns for n in ("low", "high")), F.col("along").isNotNull().alias("splittable"))
    return whole.withColumn("box", F.array_join("box", "/")), boxes


def _with_cuts(ranges: DataFrame, most: int) -> DataFrame:
    """Boxes (_n, _q, _low, _high) with _cuts and _heavy. Of the quantiles _q every so many is a cut, so that pieces are not much smaller than need be; a quantile that comes
    again is a value that fills much of the box, and is cut off on both sides."""
    q, low, high, heavy, some = (F.col(c) for c in ("_q", "_low", "_high", "_heavy", "_some"))
    step = F.greatest(F.lit(1), F.floor(F.lit(CUTS * most) / (F.col("_n") * 2)).cast("int"))  # pieces of half the limit
    ranges = ranges.withColumn("_step", step).withColumns({
        "_heavy": F.array_distinct(F.filter(F.transform(q, lambda x, i: F.when(F.get(q, i + 1) == x, x)), lambda x: x.isNotNull())),
        "_some": F.array_distinct(F.filter(F.transform(q, lambda x, i: F.when((i + 1) % F.col("_step") == 0, x)), lambda x: x.isNotNull() & (x < high))),
    })
    ranges = ranges.withColumn("_cuts", F.array_union(some, F.filter(heavy, lambda x: x < high)))
    return ranges.withColumn("_cuts", F.when(F.size("_cuts") + F.size(heavy) > 0, F.col("_cuts")).otherwise(F.array(low)))


def _number_piece(v: Column) -> Column:
    """The number of the piece that a value falls into: how many cuts are below it; null for a null."""
    return F.when(v.isNotNull(), (F.size(F.filter("_cuts", lambda x: x < v)) + F.size(F.filter("_heavy", lambda x: x <= v))).cast("string"))
