"""Streams against batches of the same rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from vinlake.operators import limits as L
from vinlake.sources import domain as D
from vinlake.streaming import merging as M
from vinlake.streaming import pipelines as P


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Request logs as several files in order of time."""
    path = str(tmp_path_factory.mktemp("logs"))
    rows = D.request_logs(spark, SF_DIR)
    for day in range(0, 30, 6):
        rows.filter((F.dayofmonth("requested_at") > day) & (F.dayofmonth("requested_at") <= day + 6)).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def read(spark, logs, late="40 days", files=2):
    return P.stream(spark, logs[1], logs[0].schema, "requested_at", late, files)


def result(spark, df, name, tmp_path, mode="complete"):
    q = P.run_to_table(df, name, str(tmp_path / "c"), mode)
    q.awaitTermination(120)
    return spark.table(name)


def test_tumbling(spark, logs, tmp_path):
    got = {(r.bucket, r.total, r.ok, r.errors) for r in result(spark, P.tumbling_usage(read(spark, logs)), "t1", tmp_path).collect()}
    want = logs[0].groupBy(F.date_trunc("day", "requested_at").alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("status_code").between(200, 299)).alias("ok"), F.count_if(F.col("status_code") >= 400).alias("e"))
    assert got == {tuple(r) for r in want.collect()}


def test_sliding_and_sessions(spark, logs, tmp_path):
    assert sum(r.total for r in result(spark, P.sliding_usage(read(spark, logs)), "t2", tmp_path).collect()) == 7 * logs[0].count()
    got = result(spark, P.client_sessions(read(spark, logs)), "t3", tmp_path / "s").count()
    assert got == L.sessions(logs[0], "client_id", "requested_at", 7200).count()


def test_append_only_once(spark, tmp_path):
    x = D.listings(spark, SF_DIR).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    for year in (1995, 1997, 1999, 2001):
        x.filter(F.year("seen_at").between(year, year + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        rows = P.once_only(P.stream(spark, str(tmp_path / "in"), x.schema, "seen_at", "30 days", 1))
        P.append_new(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out"))
    from vinlake.operators.ingest import CONTENT, status_key

    want = x.withColumn("status_key", status_key(F.col("listing_status"))).select(*CONTENT).distinct().count()
    assert out.count() == want == out.select(*CONTENT).distinct().count()


def test_daily_limit(spark, logs, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {r.id: r.allowed for r in result(spark, P.daily_limits(read(spark, logs, files=1), 2), "t4", tmp_path, "append").collect()}
    clients = logs[0].select(F.col("client_id").alias("id")).distinct().select("id", F.lit(2).alias("per_day"), F.lit(None).cast("long").alias("per_month"), F.lit(None).cast("long").alias("per_vin"))
    want = {r.id: r.verdict == "allowed" for r in L.rate_verdicts(logs[0], clients).collect()}
    assert got == want


KEYS = ("k",)


def states(spark, rows):
    raw = spark.createDataFrame(rows, "k string, listed_at timestamp_ntz, updated_at timestamp_ntz, observed_at timestamp_ntz, source_id string")
    return M.observation_states(raw, KEYS, "2024-01-31 00:00:00", ["source_id"])


def some_rows(rng, n):
    at = lambda: rng.choice([None, dt.datetime(1980, 1, 1), dt.datetime(2050, 1, 1), dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(900))])
    return [(f"k{rng.randrange(12)}" if rng.random() > 0.05 else None, at(), at(), dt.datetime(2020, 1, 5) + dt.timedelta(hours=rng.randrange(900)), f"s{rng.randrange(50)}") for _ in range(n)]


def test_merging_stream_in_any_order_and_replayed(spark, tmp_path):
    """The target equals one merge of all rows, whatever the batches' order, with batches run twice, and rows that come again."""
    rng = random.Random(3)
    batches = [some_rows(rng, 25) for _ in range(4)]
    batches.append(batches[1][:10])
    whole = M.merged_states(KEYS)(states(spark, [r for b in batches for r in b]))
    want = sorted(map(tuple, M.observations_of(whole, KEYS).collect()), key=repr)
    for trial in range(3):
        path = str(tmp_path / f"t{trial}")
        order = rng.sample(range(5), 5)
        for n, b in enumerate(order):
            for _ in range(1 + (trial == 1 and n % 2)):  # run again, as after a failure
                M.merge_batch(states(spark, batches[b]), n, path, KEYS, M.merged_states(KEYS), buckets=4)
        got = M.current(spark, path, whole.schema)
        assert sorted(map(tuple, M.observations_of(got, KEYS).collect()), key=repr) == want
        assert all(len(vs) <= 2 for vs in M.versions(spark, path).values())


def test_merge_touches_only_its_buckets_and_shows_whole_batches(spark, tmp_path):
    path, merge = str(tmp_path / "t"), M.merged_states(KEYS)
    day = dt.datetime(2020, 1, 1)
    M.merge_batch(states(spark, [(f"k{i}", day, day, day, "s") for i in range(40)]), 0, path, KEYS, merge, buckets=8)
    M.merge_batch(states(spark, [("k1", dt.datetime(2019, 1, 1), None, day, "r")]), 1, path, KEYS, merge, buckets=8)
    changed = [b for b, vs in M.versions(spark, path).items() if vs == [0, 1]]
    assert len(changed) == 1 and len(M.versions(spark, path)) == 8
    schema = states(spark, []).schema
    one = M.current(spark, path, schema, KEYS, spark.createDataFrame([("k1",)], "k string"))
    assert len(one.inputFiles()) == 1 and [tuple(r) for r in M.observations_of(one.filter("k = 'k1'"), KEYS).collect()] == [("k1", dt.datetime(2019, 1, 1), day, dt.datetime(2019, 1, 1), "r")]
    # A batch that failed before its end: some of its buckets are written, but nobody sees them, and the second try isn't disturbed.
    late = states(spark, [("k2", None, dt.datetime(2021, 1, 1), day, "q")])
    M.merge_batch(late, 2, path, KEYS, merge, buckets=8)
    (tmp_path / "t" / "_done" / "2").unlink()
    seen = {r.k: r.updated_at for r in M.current(spark, path, schema).collect()}
    assert seen["k2"] == day and len(seen) == 40
    M.merge_batch(late, 2, path, KEYS, merge, buckets=8)
    assert {r.k: r.updated_at for r in M.current(spark, path, schema).collect()}["k2"] == dt.datetime(2021, 1, 1)
    with pytest.raises(ValueError):
        M.merge_batch(late, 3, path, KEYS, merge, buckets=16)


def test_merged_target_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    M.merge_batch(states(spark, []), 0, path, KEYS, M.merged_states(KEYS), buckets=4)
    assert M.last_batch(spark, path) == 0 and M.current(spark, path, states(spark, []).schema).count() == 0


def test_throttle_leaves_no_state_behind(spark, tmp_path):
    """The batch's counts, over batches in order of time; of clients whose events the watermark has left behind no times remain."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(i, c, day + dt.timedelta(days=c, minutes=5 * rng.randrange(100))) for i, c in enumerate(rng.choice([0, 1, 4, 6]) for _ in range(120))]
    df = spark.createDataFrame(rows, "id long, client_id long, requested_at timestamp_ntz").withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    for low, high in ((0, 1), (1, 2), (2, 5), (5, 9)):
        df.filter(F.col("client_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = P.stream(spark, str(tmp_path / "in"), df.schema, "requested_at", "1 minute", 1)
    got = {(r.id, r.n, r.allowed) for r in result(spark, P.throttled(stream, 3600, 3), "t5", tmp_path, "append").collect()}
    assert got == {(r.id, r.n, r.allowed) for r in L.throttled(df, "client_id", "requested_at", 3600, 3).collect()} and len({g[2] for g in got}) == 2
    held = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "c"))
    assert {r.key.client_id for r in held.select("key").distinct().collect()} == {6}
