from __future__ import annotations

import random

import numpy as np

from tests.conftest import SF_DIR
from vinlake.llm import ann
from vinlake.llm.queries import QUERIES


def brute(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    want, got = brute(rows), {}
    for r in QUERIES["op2_nearest_vectors"](spark, SF_DIR).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = dict(rows)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((np.array(vectors[q]) - np.array(vectors[v])) ** 2).sum())) < 1e-9 for _, v, s in mine) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in near})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(40)] + [(500, None), (501, [0.0] * 8), (502, [None] + [1.0] * 7), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [1.0] * 8), (505, []), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = ann.search(df, df.filter("vec_id % 100 = 0")).collect()
    queries = {0, 100, 200, 1000}
    assert {r.query_id for r in got} == queries and not {r.vec_id for r in got} & {500, 501, 502, 503, 504, 505, None} and all(r.query_id != r.vec_id for r in got)
    tied = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 1000)
    assert tied == [(i, 1000 + i, 0.0) for i in range(1, 11)]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_counts_by_sums():
    """Strings that share a prefix, from sums over segments: exact within the own segment and over whole segments."""
    rng = np.random.default_rng(8)
    h = np.sort(rng.integers(0, 1 << ann.BITS, 4000))
    at = h[::100][1:].tolist()
    fences = ann.Fences({(8, 0): [1 << 39], (8, 1): at})
    home = fences.home(8, 1, h)
    sizes = {int(s): int((home == s).sum()) for s in np.unique(home)}
    sums = fences.sums(sizes)
    for x in h[::371]:
        own = h[home == fences.home(8, 1, np.array([x]))[0]]
        got, alone = fences.counts(8, 1, int(x), own, sums), fences.counts(8, 1, int(x), own, None)
        for bits in range(ann.BITS + 1):
            want = np.count_nonzero(h >> (ann.BITS - bits) == x >> (ann.BITS - bits)) if bits else 4000
            inside = alone[bits] == want  # the range ends within the own segment
            assert alone[bits] <= want and (abs(got[bits] - want) < 1e-6 if inside or not bits else abs(got[bits] - want) <= 200)  # two segments that are cut


def test_many_vectors_of_one_string(spark, monkeypatch):
    """Near copies that share their hash strings: their segment is dealt out, and nothing is lost."""
    monkeypatch.setattr(ann, "SEGMENT", 64)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(1000 + i, (np.ones(8) + 1e-7 * rng.standard_normal(8)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), {}
    for r in ann.search(df, df.filter("vec_id % 100 = 0"), trees=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    dense = [q for q in want if q >= 1000]
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in dense) >= 0.97 * 10 * len(dense)  # sums of squares round apart
