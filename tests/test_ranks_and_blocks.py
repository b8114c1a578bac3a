"""Exact percentiles and top lists against plain ones; samples and facts that spare reading."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vinlake.operators import ranks
from vinlake.sources import blocks as B


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, monkeypatch, share):
    """Ties, a group of one value, a heavy tail, negative numbers, nulls and a null group; few rows may be left, so that ranges are narrowed several times."""
    monkeypatch.setattr(ranks, "LAST", 3)
    rng = random.Random(1)
    rows = [("tail", 10 ** rng.uniform(-9, 9)) for _ in range(4000)] + [("ties", float(rng.choice([1, 1, 1, 2, 5]))) for _ in range(3000)] + [("one", 7.0)] * 50 + [("few", -1.5), ("few", 2.0)] + [(None, float(i)) for i in range(100)] + [("none", None)] * 3 + [("nan", float("nan")), ("nan", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    want = {r.g: r.v for r in df.filter("NOT isnan(x) OR x IS NULL").groupBy("g").agg(F.percentile("x", share).alias("v")).collect()}
    got = {r.g: r.value for r in ranks.exact_percentile(df, ["g"], "x", share).collect()}
    assert got.keys() == want.keys() and all(got[g] == want[g] or abs(got[g] - want[g]) < 1e-9 * abs(want[g]) for g in want if want[g] is not None) and got["none"] is None
    assert ranks.exact_percentile(df.limit(0), ["g"], "x", share).count() == 0


def test_exact_percentile_of_all_rows(spark):
    df = spark.range(30_001).select((F.col("id") * 37 % 30_001).alias("x"))
    assert ranks.exact_percentile(df, [], "x", 0.95).first().value == 28_500.0


@pytest.mark.parametrize("kind", ["skewed", "flat", "few"])
def test_heavy_top(spark, kind):
    rng = random.Random(2)
    draw = {"skewed": lambda: int(rng.paretovariate(0.7)), "flat": lambda: rng.randrange(3000), "few": lambda: rng.choice([None, 1, 2])}[kind]
    rows = [(draw() if kind == "few" else min(draw(), 10**6), rng.randrange(2)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "k long, j int")
    want = df.groupBy("k", "j").count().orderBy(F.desc("count"), F.asc_nulls_first("k"), "j").limit(25).collect()
    for buckets in (16, 1 << 12):
        assert list(map(tuple, ranks.heavy_top(df, ["k", "j"], 25, buckets).collect())) == list(map(tuple, want))
    assert ranks.heavy_top(df.limit(0), ["k"], 5).count() == 0


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Rows in the order of their key, in many small row groups of several files."""
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    rows = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("k"), (F.xxhash64("id") % 100).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("w"))
    rows.write.option("parquet.block.size", 64 * 1024).option("parquet.page.size", 4096).option("parquet.enable.dictionary", "false").parquet(path)
    return path


def rows_read(df) -> int:
    """Rows that the scans of a frame gave out, once it is collected."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.startswith("Scan") or "BatchScan" in name:
            n += p.metrics().get("numOutputRows").get().value()
        plan = getattr(p, "plan", None)
        if "QueryStage" in name:
            todo.append(plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_facts_come_from_footers(spark, table):
    assert tuple(B.footer_facts(spark, table, "k", "w").first()) == (200_000, 0, 199_999, 0, 49)
    plan = B.footer_plan(spark, table, "k", "w")
    assert "PushedAggregation: [COUNT(*), MIN(k), MAX(k), MIN(w), MAX(w)]" in plan
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert "parquet" in before  # the setting is put back


def test_block_sample_reads_its_share(spark, table):
    rows, design = B.block_sample(spark, table, "k", 0.1)
    assert 5 < len(design.drawn) < 40 and design.total == 200_000
    read = rows_read(rows.agg(F.count("v"), F.max("block")))
    assert 0 < read < 0.35 * design.total  # the row groups that meet a drawn block
    assert {r.block for r in rows.select("block").distinct().collect()} == set(design.drawn)
    exact = spark.read.parquet(table)
    for what in (F.col("v") < 30, F.col("w").isNull(), F.col("k") < 90_000):  # evenly spread, and in half of the blocks alone
        got = B.estimated(rows, what, design).first()
        assert abs(got.estimate - exact.filter(what).count()) <= got.bound and got.n_sampled == rows.count() and got.total == 200_000


def test_file_sample_opens_only_its_files(spark, table):
    some, n, of = B.file_sample(spark, table, 0.6)
    assert of == 4 and len(some.inputFiles()) == n <= of and some.count() == n * 50_000
    none, n, _ = B.file_sample(spark, table, 0.0)
    assert n == 0 and none.count() == 0


def test_small_and_empty_tables(spark, tmp_path):
    for n in (0, 1, 30):
        path = str(tmp_path / str(n))
        spark.range(n).select(F.col("id").alias("k")).write.parquet(path)
        rows, design = B.block_sample(spark, path, "k", 0.5)
        got = B.estimated(rows, F.lit(True), design).first()
        assert (got.total, got.bound) == (n, None) and got.estimate == int(n * B.SHARE + 0.5)  # too few rows: a fixed share
