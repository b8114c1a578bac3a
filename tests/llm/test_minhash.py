from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from tests.conftest import SF_DIR
from tests.llm.odd import odd_docs
from tests.llm.test_simhash import components, shingles
from vinlake.llm import minhash
from vinlake.llm.queries import QUERIES


def linked(a, b):
    n = len(a & b)
    return bool(a and b) and 100 * n >= 85 * (len(a) + len(b) - n)


def wanted(sets):
    return components(sets, [(a, b) for a, b in combinations(sets, 2) if min(len(sets[a]), len(sets[b])) * 100 >= 85 * max(len(sets[a]), len(sets[b])) and linked(sets[a], sets[b])])


def test_query_against_all_pairs(spark):
    for sf in ("sf0.001", "sf0.01"):
        at = SF_DIR.replace("sf0.001", sf)
        sets = {d.doc_id: shingles(d.text) for d in spark.read.parquet(f"{at}/documents.parquet").collect()}
        root = wanted(sets)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op11_minhash"](spark, at).collect()}
        assert got == {i: (len(x), root[i], root[i] == i) for i, x in sets.items()}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85):
        common = rng.integers(0, 2**64, int(2000 * share), np.uint64, endpoint=False)
        one, two = (np.unique(np.concatenate([common, rng.integers(0, 2**64, (2000 - len(common)) // 2, np.uint64, endpoint=False)])) for _ in range(2))
        same = (minhash.signature(one) == minhash.signature(two)).mean()
        assert abs(same - len(common) / (len(one) + len(two) - len(common))) < 0.1


def test_circulant_coordinates_against_the_definition():
    """Coordinate k of a set is the least rank over its scattered places, each turned by k on the ring."""
    rng = np.random.default_rng(2)
    shingles_ = rng.integers(0, 2**64, 700, np.uint64, endpoint=False)
    first, turned = minhash._permutations()
    size, ranks = 1 << minhash.RING, turned[:, 0]
    assert len(np.unique(first)) == size == len(np.unique(ranks))
    places = first[(shingles_ >> np.uint64(64 - minhash.RING)).astype(np.int64)].astype(np.int64)
    want = [ranks[(places + k) % size].min() for k in range(minhash.COORDS)]
    assert minhash.signature(shingles_).tolist() == want


def test_a_large_group_a_chain_and_the_limit(spark):
    """Near copies of one text on both sides of the limit, a chain of which only neighbours are alike, and pairs exactly at 85 % and just below."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(400), rng.randint(1, 16)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(700)]
    texts += [" ".join(chain[i * 20 : i * 20 + 400]) for i in range(9)]
    whole = [f"e{i}" for i in range(104)]  # 100 shingles; the first k + 4 words have k of them
    texts += [" ".join(whole), " ".join(whole[:89]).upper(), " ".join(["f"] + [f"g{i}" for i in range(103)]), " ".join(["f"] + [f"g{i}" for i in range(87)])]
    sets = dict(enumerate(map(shingles, texts)))
    assert [len(sets[i]) for i in range(160, 164)] == [100, 85, 100, 84]
    want = wanted(sets)
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and want[161] == 160 and want[163] == 163


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = minhash.near_copies(df).collect()
    assert len(got) == df.count()
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 0, 3, 11)}
    assert by_id[6].component_id == 5 and not by_id[6].kept and by_id[5].kept and by_id[12].component_id == 11
    assert {(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id == 0} == {(0, True, 0)} and by_id[1].component_id == 1 and by_id[2].component_id == 2
    assert by_id[3 + 1].n_shingles == 1 and by_id[10].n_shingles == 1  # one two; word word word ...
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and all(r.component_id is None and r.kept for r in nulls)
    assert minhash.near_copies(odd_docs(spark, 0)).count() == 0 and minhash.near_copies(df.filter("text = 'one'")).count() == 1
    long = " ".join(f"w{i % 90_000}" for i in range(250_000))  # over 1 MB
    two = spark.createDataFrame([(1, long), (2, long + " and more"), (3, long[:1_000_000])], "doc_id long, text string")
    sets = {r.doc_id: shingles(r.text) for r in two.collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_copies(two).collect()} == {i: (len(x), wanted(sets)[i]) for i, x in sets.items()}
