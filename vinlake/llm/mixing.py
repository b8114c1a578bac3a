"""Mixing sources to target weights.

Each source's documents stand in a pseudo-random order as one stream of words, cut into blocks. The mix takes whole epochs of a source and, of one more epoch, a
number of blocks in permuted order. Output shards get exact quotas of blocks: a tree halves the shards again and again, and at each node the left half's blocks of
each source are drawn from the multivariate hypergeometric distribution, so shards look like random deals of the mix but add up exactly. A shard's blocks of a
source are a run of the source's draws, so no two shards share one, and rows are shuffled within their shard by hash.

All of it is DataFrame functions, without Python on rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinlake.llm.common import WORD, as_table, broadcast_if_small

#: Weights of sources in code point order, null last, again and again.
WEIGHTS = (1, 2, 3)
#: A source's target is at most so many times its size.
MOST = 3
#: Words of a block, shards of the mix (a power of two) and rounds of the block permutation.
BLOCK, SHARDS, ROUNDS = 4096, 32, 24
#: Words of a shard's rows that one task sorts; larger shards are dealt out in parts by hash.
PART_WORDS = 2_000_000
#: Parts of a source's order that are summed apart, so that no task gets a whole source; more of them from PARTS * PART_ROWS rows on, so that parts don't grow.
PARTS, PART_ROWS = 4096, 100_000
#: Sources whose draws (not documents) stand in one row of the splitting tree. More of them are dealt out to groups: each node draws the groups' blocks first, then those of
#: each group's sources, which is the same distribution.
SOURCES = 10_000
#: Sources that are broadcast at most.
MAX_BROADCAST = 50_000
_SEED = 20_011


def sizes(text: Column) -> Column:
    """Words (runs of other than ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of all words by weight, at most `most` times a source's size, the excess shared again by
    weight among the others until none is above.

    A source is capped if its limit over its weight is below the level at which the rest fits, so sources are taken in order of that ratio and the level follows
    from running sums: the repeated sharing in one pass. One row a source.
    """
    # One task sorts all sources: rows of sums, not of documents.
    s = sources.select("source", "source_size", F.when(F.col("source").isNull(), 1).otherwise(0).alias("last"))
    order = F.row_number().over(Window.orderBy("last", F.col("source").cast("binary"))) - 1
    s = s.select("source", "source_size", F.get(F.array(*(F.lit(float(w)) for w in weights)), order % len(weights)).alias("w"))
    everything = Window.orderBy("ratio", "w", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("ratio", most * F.col("source_size") / F.col("w"))
    total = Window.partitionBy()
    s = s.select("*", F.sum("source_size").over(total).alias("all_size"), F.sum("w").over(total).alias("all_w"), F.sum(most * F.col("source_size")).over(everything).alias("capped"), F.sum("w").over(everything).alias("capped_w"))
    # The level if all up to this source are capped; the first source that is not above its level ends the capping.
    before, before_w = F.col("capped") - most * F.col("source_size"), F.col("capped_w") - F.col("w")
    level = (F.col("all_size") - before) / (F.col("all_w") - before_w)
    s = s.withColumn("level", F.when(F.col("ratio") >= level, level)).withColumn("level", F.max("level").over(total))
    return s.select("source", "source_size", F.least(F.coalesce(F.col("w") * F.col("level"), F.lit(float("inf"))), (most * F.col("source_size")).cast("double")).alias("target"))


def _hash(*cols: Column | int) -> Column:
    return F.xxhash64(F.lit(_SEED), *(c if isinstance(c, Column) else F.lit(c) for c in cols))


def _uniform(*cols: Column | int) -> Column:
    return F.shiftrightunsigned(_hash(*cols), 11).cast("double") * (2.0**-53)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: Spark copies an expression wherever it stands, and those of copies grow without end."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ln_fact(n: Column) -> Column:
    """ln(n!) by Stirling's series, moved up by 8 so that it is exact to 1e-13."""

    def series(z: Column) -> Column:
        low = z - 8
        for i in range(7, 0, -1):
            low = low * (z - i)
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(low)

    return _let(n + 9.0, series)


def hypergeometric(good: Column, all_: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` from `all_`, without putting back, are among `good`: by inversion at u. Exact to double precision: 12 deviations around the mean are
    searched, beyond which less than 1e-30 lies."""

    def bounds(x: Column) -> Column:
        g, n, d = x["g"], x["n"], x["d"]
        mean = g * d / n
        wide = 12 * F.sqrt(F.greatest(mean * (1 - g / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) + 12
        return F.struct(F.greatest(F.lit(0.0), d - (n - g), F.floor(mean - wide).cast("double")).alias("low"), F.least(g, d, F.ceil(mean + wide).cast("double")).alias("high"))

    def search(x: Column) -> Column:
        g, n, d = x["g"], x["n"], x["d"]

        def inverted(at: Column) -> Column:
            low, high = at["low"], at["high"]
            ln = lambda a, b: _ln_fact(a) - _ln_fact(b) - _ln_fact(a - b)
            first = F.exp(ln(g, low) + ln(n - g, d - low) - ln(n, d))

            def step(acc: Column, k: Column) -> Column:
                p = acc["p"] * (g - acc["k"]) * (d - acc["k"]) / ((acc["k"] + 1) * (n - g - d + acc["k"] + 1))
                return F.when((acc["sum"] >= x["u"]) | (acc["k"] >= high), acc).otherwise(F.struct((acc["k"] + 1).alias("k"), p.alias("p"), (acc["sum"] + p).alias("sum")))

            start = _let(first, lambda p: F.struct(low.alias("k"), p.alias("p"), p.alias("sum")))
            return F.aggregate(F.sequence(F.lit(0), F.greatest(high - low, F.lit(0.0)).cast("int")), start, step, lambda acc: acc["k"].cast("long"))

        found = _let(bounds(x), inverted)
        return F.when((x["g"] <= 0) | (x["d"] <= 0), F.lit(0).cast("long")).when(x["d"] >= x["n"], x["g"].cast("long")).otherwise(found)

    return _let(F.struct(good.cast("double").alias("g"), F.greatest(all_, F.lit(1)).cast("double").alias("n"), drawn.cast("double").alias("d"), u.alias("u")), search)


def shard_quotas(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, bounds): for (source, draws), the draws at which each shard's run of the source ends, of `shards` shards (a power of two).

    A row a node of the splitting tree and group of sources, with an array over the sources, is split into two at each level. Up to SOURCES sources are one group; else
    there are about as many groups as sources in a group, so that neither array is long.
    """
    n = sources.count()
    size = SOURCES if n <= SOURCES else max(ceil(n**0.5), 1)
    one = sources.select(F.col("source").isNull().alias("none"), "source", "draws")
    if n <= SOURCES:
        one = one.withColumn("g", F.lit(0))
    else:
        one = one.withColumn("g", F.floor((F.row_number().over(Window.orderBy("none", "source")) - 1) / size).cast("int"))  # a row a source
    node = one.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("none", "source", "draws"))).alias("s"))
    node = node.select(F.lit(0).alias("node"), "g", F.transform("s", lambda x: x["draws"]).alias("q"), F.transform("s", lambda x: x["source"]).alias("names"))
    half = lambda bit, q: F.struct((2 * F.col("node") + bit).alias("node"), q.alias("q"))
    for level in range(shards.bit_length() - 1):
        total = _total("q")
        need = F.floor((total + F.pmod(_hash(F.col("node"), level), F.lit(2))) / 2).cast("long")
        if n > SOURCES:
            # The groups' own shares of the left half, of their totals, as if they were sources.
            sums = node.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("g", total.alias("t")))).alias("a")).select("node", F.transform("a", lambda x: x["t"]).alias("q"))
            sums = sums.select("node", F.posexplode(_left("q", need, level, -1)).alias("g2", "need"))
            node = node.join(as_table(sums.select(F.col("node").alias("n2"), "g2", "need")), (F.col("node") == F.col("n2")) & (F.col("g") == F.col("g2")))
            left = _left("q", F.col("need"), level, F.col("g"))
        else:
            left = _left("q", need, level)
        halves = _let(left, lambda one: F.array(half(0, one), half(1, F.zip_with("q", one, lambda a, b: a - b))))
        node = as_table(node.select("g", "names", F.explode(halves).alias("h")).select("h.node", "g", "names", "h.q"))
    each = node.select("node", F.explode(F.arrays_zip(F.col("names").alias("source"), F.col("q").alias("n"))).alias("x")).select("node", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    runs = each.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("a"))
    ends = F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: F.aggregate(F.slice("a", 1, i), F.lit(0).cast("long"), lambda t, x: t + x["n"]))
    return runs.select("source", ends.alias("bounds"))


def _total(q: str) -> Column:
    return F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)


def _left(q: str, need: Column, level: int, *key: Column | int) -> Column:
    """How many of the blocks of each element of q the left half gets, of `need` in all: each in turn takes its share of what is still needed, out of those not yet looked at."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), _total(q).alias("rest"), need.alias("need"))
    return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), start, lambda acc, i: _take(acc, i, F.get(q, i), level, *key), lambda acc: acc["out"])


def _take(acc: Column, i: Column, have: Column, level: int, *key: Column | int) -> Column:
    got = hypergeometric(have, acc["rest"], acc["need"], _uniform(F.col("node"), level, *key, i))
    return _let(got, lambda n: F.struct(F.concat(acc["out"], F.array(n)).alias("out"), (acc["rest"] - have).alias("rest"), (acc["need"] - n).alias("need")))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where block x of n stands in the permuted order: the swap-or-not shuffle, a bijection of 0..n-1 for every n."""

    def swap(now: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(_hash(key, r), n) - now, n)
        return F.when(F.pmod(_hash(key, r, F.greatest(now, other), n), F.lit(2)) == 1, other).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def plan(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs, pieces, whole, shards, parts) of every row, then the columns of carry.

    size: words of the text; target: the words that the mix should hold of the row's source; taken: those that it holds of this row, repeats counted. epochs: how
    often the whole text is taken; pieces: what is taken of it in one more epoch, as (first word, words, shard) with words counted from 0; shards: those that hold
    a part of the row; whole: the shard of each whole text; parts: in how many parts each shard is shuffled. A source's taken words differ from its target by the rounding to a word alone.

    Null and empty texts have size 0 and nothing is taken of them. Null sources are one source, the last. Null ids, repeated ids and repeated rows are rows like any
    other. Reruns agree: the order of a source follows from hashes of ids and texts.
    """
    names = [f"c{i}" for i in range(len(carry))]
    t = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), sizes(t).alias("size"), F.xxhash64(F.lit(_SEED), F.col(id_col), t).alias("h"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    docs = docs.withColumn("part", F.pmod("h", F.lit(max(PARTS, df.count() // PART_ROWS))).cast("int"))
    parts = as_table(docs.groupBy("source", "part").agg(F.sum("size").alias("n")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = as_table(parts.select(F.col("source").alias("s2"), F.col("part").alias("p2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n"))
    sources = as_table(parts.groupBy(F.col("s2").alias("source")).agg(F.sum("n").alias("source_size")))
    goal = targets(sources, weights, most)
    words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    n = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long")
    goal = goal.select("*", full.alias("epochs"), n.alias("blocks"), F.greatest(words - full * F.col("source_size"), F.lit(0)).cast("long").alias("rest"))
    goal = goal.withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * block)  # words of the last block
    goal = goal.withColumn("tail_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64("source")))
    goal = as_table(goal.withColumn("draws", F.when(F.col("source_size") == 0, 0).otherwise(F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long")))
    total = goal.agg(F.sum("target")).first()[0] or 0  # one row a source
    parts_of_shard = max(1, ceil(total / (shards * PART_WORDS)))
    goal = goal.select(F.col("source").alias("s3"), "source_size", "target", "epochs", "blocks", "rest", "tail", "tail_at").join(shard_quotas(goal.select("source", "draws"), shards).withColumnRenamed("source", "s4"), F.col("s3").eqNullSafe(F.col("s4")), "left").drop("s4")
    goal = broadcast_if_small(as_table(goal), MAX_BROADCAST)
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(broadcast_if_small(parts.select("s2", "p2", "before"), 4 * MAX_BROADCAST), F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    docs = docs.join(goal, F.col("source").eqNullSafe(F.col("s3"))).withColumn("start", F.col("before") + F.col("inside"))
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")

    def shard_of(draw: Column) -> Column:
        return F.size(F.filter("bounds", lambda b: b <= draw))

    def piece(b: Column) -> Column:
        return _let(permuted(b, F.col("blocks"), F.xxhash64("source")), lambda at: placed(b, at))

    def placed(b: Column, at: Column) -> Column:
        drawn_before = at * block - F.when(F.col("tail_at") < at, block - F.col("tail")).otherwise(0)
        length = F.when(b == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block))
        taken = F.greatest(F.least(F.col("rest") - drawn_before, length), F.lit(0))  # of the block, from its first word on
        begin, end = F.greatest(F.col("start"), b * block), F.least(F.col("start") + F.col("size"), b * block + taken)
        return F.struct((begin - F.col("start")).alias("first"), F.greatest(end - begin, F.lit(0)).cast("long").alias("words"), shard_of(F.col("epochs") * F.col("blocks") + at).alias("shard"))

    pieces = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.filter(F.transform(F.sequence(first, last), piece), lambda p: p["words"] > 0)).otherwise(F.array().cast("array<struct<first:bigint,words:bigint,shard:int>>"))
    docs = docs.withColumn("pieces", pieces)
    extra = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    home = permuted(first, F.col("blocks"), F.xxhash64("source"))  # a whole text goes where the block of its first word goes
    epochs = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("epochs") - 1, F.lit(0).cast("long")))
    whole = F.when((F.col("epochs") > 0) & (F.col("size") > 0), _let(home, lambda at: F.transform(epochs, lambda e: shard_of(e * F.col("blocks") + at)))).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("whole", whole)
    return docs.select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken"), "epochs", "pieces", "whole",
        F.array_sort(F.array_distinct(F.concat("whole", F.transform("pieces", lambda p: p["shard"])))).alias("shards"), F.lit(parts_of_shard).alias("parts"),
        *(F.col(n).alias(c) for c, n in zip(carry, names)),
    )


def mixed(planned: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(shard, text_col, then keep): the rows of the mix, from plan(..., carry=(text_col, *keep)): a row for each whole text taken, and one for each piece of a text
    (with the white space between its words). A shard's rows are dealt out by hash into its parts, and stand in a pseudo-random order within each."""
    word = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
    # Whole texts and pieces come out of one array, so texts are planned and shuffled once.
    taken = F.concat(F.transform("whole", lambda s: F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("words"), s.alias("shard"))), "pieces")
    rows = planned.select(F.explode(taken).alias("p"), F.col(text_col).alias("t"), "size", "parts", *keep)
    part = F.ltrim(F.array_join(F.slice(F.regexp_extract_all("t", F.lit(word), 0), (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), ""))
    rows = rows.select(F.col("p.shard").alias("shard"), F.when(F.col("p.words") == F.col("size"), F.col("t")).otherwise(part).alias(text_col), F.col("parts").alias("_parts"), *keep)
    rows = rows.withColumn("_h", F.xxhash64(F.lit(_SEED), *(F.col(c) for c in (text_col, *keep))))
    rows = rows.withColumn("_part", F.pmod("_h", F.col("_parts"))).repartition("shard", "_part")
    return rows.sortWithinPartitions("shard", "_part", "_h").select("shard", text_col, *keep)
