from __future__ import annotations

import hashlib
import math

import numpy as np

from tests.conftest import SF_DIR, rows_of
from vinlake.llm import centroids
from vinlake.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, clusters=40, rounds=5):
    """In Python's integers, one distance after the other."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, v, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v]) for i, v in kept]
    seeds = sorted(whole, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    now = [w for *_, w in seeds]

    def nearest(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        of = [nearest(w)[1] for *_, w in whole]
        for k in set(of):
            mine = [w for (*_, w), o in zip(whole, of) if o == k]
            now[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(w) for *_, w in whole]
    per = {k: sum(d for d, o in last if o == k) for _, k in last}
    fits = lambda n: n if n < 2**63 else None
    lost = {k for d, k in last if d >= 2**63}
    return [(i, k, fits(d), None if k in lost else fits(per[k]), None if lost else fits(sum(per.values())), hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest()) for (i, *_), (d, k) in zip(whole, last)]


def same(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_query_against_sql(spark, duck):
    got, want = QUERIES["op13_centroids"](spark, SF_DIR), duck.sql(ORACLE_SQL["op13_centroids"])
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 64).astype(float).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (70, []), (71, [1.0] * 63), (72, [None] + [0.0] * 63), (73, [float("nan")] * 64), (74, [float("inf")] * 64), (75, [0.0] * 64), (76, [-0.001] * 64), (77, [0.0] * 64)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int, v double")
    assert same(centroids.cluster(df).collect(), brute(rows))
    few = df.filter("vec_id < 3")
    got = centroids.cluster(few).collect()
    assert len(got) == 3 and {r.cluster for r in got} == {0, 1, 2} and {r.inertia for r in got} == {0}
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.filter("vec_id between 70 and 74")).count() == 0
    one = spark.createDataFrame([(5, [0.5] * 64)] * 300, "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance) for r in centroids.cluster(one).collect()} == {(0, 0)}


def test_large_magnitudes(spark):
    """Beyond floats' 2^53 by 64-bit integers, beyond those by Python's; small vectors beside them."""
    rng = np.random.default_rng(5)
    for scale in (2.0**20, 2.0**21.6, 2.0**30, 2.0**60, 1e300, 1.7e308):
        rows = [(i, (rng.random(64) * scale).tolist()) for i in range(45)] + [(100 + i, rng.random(64).tolist()) for i in range(45)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert same(centroids.cluster(df).collect(), brute(rows)), scale


def test_distances_agree_in_each_kind():
    rng = np.random.default_rng(6)
    for most in (2**20, 2**22, 2**27, 2**40):
        x = rng.integers(-most, most, (50, 64)).astype(float)
        c = np.array([[int(v) for v in row] for row in rng.integers(-most, most, (7, 64))], dtype=object)
        want = [[sum((int(a) - b) ** 2 for a, b in zip(r, k)) for k in c] for r in x]
        assert [[int(v) for v in r] for r in centroids.distances(x, c)] == want
