"""Facts about Parquet tables that spare reading them: counts and bounds from footers, and samples of whole blocks with a bound of their error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a key's range, and deviations of a bound.
BLOCKS, DEVIATIONS = 200, 2.6
# Under so many sampled rows an estimate is this share of the total.
LEAST_ROWS, SHARE = 50, 0.65


@contextmanager
def _pushing(spark: SparkSession) -> Iterator[None]:
    """Parquet through the reader that can answer counts, minima and maxima from footers; settings are put back."""
    want = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _facts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))


def footer_facts(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """(n, low_<column>, high_<column>...): the rows of a Parquet table and the bounds of columns, in one row (S8). For numbers, booleans and dates all comes from the footers,
    which hold a few numbers for each row group; columns of other kinds (texts are cut there) are read. It is computed at once."""
    with _pushing(spark):
        found = _facts(spark, path, columns)
        n, *bounds = found.first()
        return spark.createDataFrame([(n or 0, *bounds)], found.schema)  # without a row group the footers add up to nothing


def footer_plan(spark: SparkSession, path: str, *columns: str) -> str:
    """The plan of footer_facts: what is pushed into the scan."""
    with _pushing(spark):
        return _facts(spark, path, columns)._jdf.queryExecution().executedPlan().toString()


@dataclass(frozen=True)
class Blocks:
    """A table's range of a whole-number key, cut into blocks of equal width, of which some are drawn by their number alone."""

    low: int
    width: int
    count: int
    drawn: tuple[int, ...]
    total: int

    def number(self, key: Column) -> Column:
        return F.floor((key - self.low) / self.width).cast("int")

    def condition(self, key: str) -> Column:
        """Ranges of the key, neighbours joined: Parquet skips the row groups outside."""
        out, at = F.lit(False), 0
        while at < len(self.drawn):
            end = at
            while end + 1 < len(self.drawn) and self.drawn[end + 1] == self.drawn[end] + 1:
                end += 1
            out = out | F.col(key).between(self.low + self.drawn[at] * self.width, self.low + (self.drawn[end] + 1) * self.width - 1)
            at = end + 1
        return out


def is_drawn(block: int, share: float) -> bool:
    """Whether a block is in the sample: the same ones on every run."""
    return (block * 2654435761) % 2**32 < share * 2**32


def block_sample(spark: SparkSession, path: str, key: str, share: float, blocks: int = BLOCKS) -> tuple[DataFrame, Blocks]:
    """Rows of whole blocks of the key's range with their `block`, and the design of the sample (S7). The range and the number of rows come from footers, and only row groups
    that meet a drawn block are read: a table that is written in the key's order is read to that share. Rows with a null key are in no block."""
    facts = footer_facts(spark, path, key).first()
    low, high = facts[f"low_{key}"], facts[f"high_{key}"]
    if low is None:
        design = Blocks(0, 1, 0, (), facts.n)
    else:
        width = -(-(high - low + 1) // blocks)
        count = -(-(high - low + 1) // width)
        design = Blocks(low, width, count, tuple(b for b in range(count) if is_drawn(b, share)), facts.n)
    rows = spark.read.parquet(path).filter(design.condition(key))
    return rows.withColumn("block", design.number(F.col(key))), design


def file_sample(spark: SparkSession, path: str, share: float) -> tuple[DataFrame, int, int]:
    """Rows of whole files of a table, how many files those are, and how many there are (S7): files that aren't drawn are never opened. Names are listed, and drawn by their hash."""
    import zlib

    table = spark.read.parquet(path)
    files = sorted(table.inputFiles())
    some = [f for f in files if is_drawn(zlib.crc32(f.rpartition("/")[2].encode()), share)]
    return (spark.read.schema(table.schema).parquet(*some) if some else table.limit(0)), len(some), len(files)


def estimated(sample: DataFrame, what: Column, design: Blocks) -> DataFrame:
    """(estimate, bound, n_sampled, total): how many rows of the whole table `what` holds for (A18), by the share in the sampled blocks. bound: DEVIATIONS standard deviations
    of that, from how much the blocks differ; null with fewer than two. Under LEAST_ROWS sampled rows the estimate is a fixed share of the total, without a bound.

    Blocks are summed up first, so what reaches one task is a row a block."""
    # A drawn block without rows still counts: it has its say in how much blocks differ.
    per = sample.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.count_if(what).alias("y"))
    b = float(len(design.drawn))
    sums = per.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(n) for n, x in (("m", F.col("m")), ("y", F.col("y")), ("yy", F.col("y") * F.col("y")), ("ym", F.col("y") * F.col("m")), ("mm", F.col("m") * F.col("m")))))
    p = F.col("y") / F.col("m")
    spread = F.greatest(F.col("yy") - 2 * p * F.col("ym") + p * p * F.col("mm"), F.lit(0.0)) / max(1.0, b - 1)
    deviation = F.sqrt((1 - b / max(1, design.count)) * b * spread) / F.col("m") * design.total
    enough = F.col("m") >= LEAST_ROWS
    return sums.select(
        F.when(enough, F.floor(design.total * p + 0.5)).otherwise(F.floor(F.lit(design.total * SHARE) + 0.5)).cast("long").alias("estimate"), F.when(enough & (F.lit(b) > 1), DEVIATIONS * deviation).alias("bound"),
        F.col("m").cast("long").alias("n_sampled"), F.lit(design.total).cast("long").alias("total"),
    )
