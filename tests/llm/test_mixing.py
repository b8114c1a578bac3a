from __future__ import annotations

from math import comb

from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from vinlake.llm import mixing
from vinlake.llm.queries import QUERIES


def shares(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        rest = total - sum(fixed.values())
        got = {n: rest * w[n] / sum(w[x] for x in free) for n in free}
        over = [n for n in free if got[n] > most * sizes[n] + 1e-9]
        if not over:
            return fixed | got
        fixed |= {n: most * sizes[n] for n in over}


def test_targets_and_taken(spark):
    out = QUERIES["op5_mixing"](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    size = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    assert sorted(r.doc_id for r in out) == sorted(size) and all(r.size == size[r.doc_id] for r in out)
    sums: dict = {}
    for i, n in size.items():
        sums[source[i]] = sums.get(source[i], 0) + n
    want, taken = shares(sums), {}
    for r in out:
        assert r.source_size == sums[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = QUERIES["op5_mixing"](spark, SF_DIR).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_odd_rows_and_text_of_the_mix(spark):
    rows = [(1, "a b c", None, 9), (1, "a b c", None, 9), (None, "x " * 40, "s", 1), (3, None, "s", 2), (4, "", "t", 3), (5, "k\tl\n m", "t", 4), (6, "word " * 5000, "big", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    planned = mixing.plan(df, carry=("text", "taken"), block=8, shards=4)
    got = planned.collect()
    assert len(got) == 7 and [r.taken for r in got if r.doc_id in (3, 4)] == [0, 0]  # a null text and an empty one
    mixed = mixing.mixed(mixing.plan(df, carry=("text",), block=8, shards=4), "text")
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert abs(words - sum(len((t or "").split()) for _, t, _, _ in rows)) <= 4
    assert mixing.plan(df.limit(0)).count() == 0


def test_many_sources(spark, monkeypatch):
    """More sources than one row holds: exact targets, and the same invariants of the shards' quotas with few or many groups."""
    rows = spark.range(10_001).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 7).cast("int")).alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    rows = rows.withColumn("source", F.when(F.col("doc_id") > 0, F.col("source")))
    got = mixing.plan(rows, carry=("source",), shards=4).collect()
    sums = {None if i == 0 else f"s{i}": i % 7 for i in range(10_001)}
    want = shares(sums)
    assert len(got) == 10_001 and all(abs(r.target - want[r.source]) < 1e-6 and abs(r.taken - r.target) <= 1 for r in got)
    s = spark.createDataFrame([(f"s{i:03}" if i else None, i * 37 % 101) for i in range(150)], "source string, draws long")
    for most in (1_000, 40, 2):
        monkeypatch.setattr(mixing, "SOURCES", most)
        bounds = {r.source: r.bounds for r in mixing.shard_quotas(s, 8).collect()}
        assert {k: v[-1] for k, v in bounds.items()} == {r.source: r.draws for r in s.collect()} and all(v == sorted(v) and len(v) == 8 for v in bounds.values())
        sizes = [sum(v[i] - (v[i - 1] if i else 0) for v in bounds.values()) for i in range(8)]
        assert max(sizes) - min(sizes) <= 3
        spread = [v[3] / v[-1] for v in bounds.values() if v[-1] > 50]  # the first half of the shards gets about half of each
        assert 0.25 < min(spread) and max(spread) < 0.75 and abs(sum(spread) / len(spread) - 0.5) < 0.03


def test_parts_change_nothing_but_the_order(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sums = lambda: {tuple(r) for r in mixing.plan(docs, carry=("source",)).groupBy("source", "source_size", "target").agg(F.sum("taken")).collect()}
    one = sums()
    monkeypatch.setattr(mixing, "PARTS", 7)
    assert sums() == one


def test_draws(spark):
    df = spark.createDataFrame([(g, n, d, u) for g, n, d in ((3, 10, 4), (50, 100, 37), (1, 5, 5), (0, 4, 2), (900, 1000, 500)) for u in (0.01, 0.3, 0.47, 0.9, 0.999)], "g long, n long, d long, u double")
    for r in df.withColumn("k", mixing.hypergeometric(F.col("g"), F.col("n"), F.col("d"), F.col("u"))).collect():
        total, k = 0.0, max(0, r.d - (r.n - r.g))
        while True:
            total += comb(r.g, k) * comb(r.n - r.g, r.d - k) / comb(r.n, r.d)
            if total >= r.u or k >= min(r.g, r.d):
                break
            k += 1
        assert r.k == k
    for n in (1, 2, 7, 64, 1001):
        at = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in at) == list(range(n))


def test_quotas_add_up(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 17), (None, 3), ("c", 0)], "source string, draws long")
    got = {r.source: r.bounds for r in mixing.shard_quotas(s, 8).collect()}
    ends = {k: v[-1] for k, v in got.items()}
    assert ends == {"a": 1000, "b": 17, None: 3, "c": 0} and all(v == sorted(v) and len(v) == 8 for v in got.values())
    sizes = [sum(v[i] - (v[i - 1] if i else 0) for v in got.values()) for i in range(8)]
    assert max(sizes) - min(sizes) <= 3
