from __future__ import annotations

import random
from itertools import combinations

import xxhash

from tests.conftest import SF_DIR
from tests.llm.odd import odd_docs
from vinlake.llm import simhash
from vinlake.llm.queries import QUERIES


def fingerprint(text, width):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_all_pairs(spark):
    got = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    fp = {d.doc_id: fingerprint(d.text, 3) for d in docs}
    want = components(fp, [(a, b) for a, b in combinations(fp, 2) if bin(fp[a] ^ fp[b]).count("1") <= 2])
    assert {i: (f"{fp[i]:016x}", want[i]) for i in fp} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    for bits in (1, 2, 3, 5):
        fps = {rng.getrandbits(64) for _ in range(30)}
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, bits + 2))) for f in list(fps) for _ in range(4)}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).distinct().collect()
        want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits}
        assert {(r.a, r.b) for r in found} == want


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def alike(a, b):
    return a == b or (len(a & b) >= 0.8 * len(a | b))


def test_similar_texts_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    sets = {d.doc_id: shingles(d.text) for d in docs.collect()}
    assert got == components(sets, [(a, b) for a, b in combinations(sets, 2) if alike(sets[a], sets[b])])


def test_similar_texts_in_a_large_group(spark):
    """Near copies of one text, and a chain of texts of which only neighbours are alike."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(120):
        w = list(base)
        for at in rng.sample(range(400), rng.randint(1, 9)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(700)]
    texts += [" ".join(chain[i * 30 : i * 30 + 400]) for i in range(8)]
    sets = [shingles(t) for t in texts]
    want = components(range(len(texts)), [(a, b) for a, b in combinations(range(len(texts)), 2) if alike(sets[a], sets[b])])
    got = simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    wrong = [r.doc_id for r in got if want[r.doc_id] != r.component_id]
    assert len(wrong) <= 1 and len(got) == len(texts)


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count() and {r.component_id for r in got if r.fingerprint == "0" * 16 and r.doc_id is not None} == {0}
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == by_id[6].component_id == 5 and by_id[11].component_id == by_id[12].component_id
    same = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert same[6] == 5 and same[12] == 11 and same[2] == 0
    for f in (simhash.near_duplicates, simhash.similar_texts):
        assert f(odd_docs(spark, 0)).count() == 0 and f(odd_docs(spark).filter("text = 'one'")).count() == 1
