"""Toxicity and quality: held-out accuracy, exactness of the index, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tests.llm.odd import odd_docs
from vinlake.llm import quality_model, toxicity
from vinlake.llm.queries import QUERIES

SF = SF_DIR.replace("sf0.001", "sf0.01")


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def held(spark, name, label):
    got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(0 <= r.score <= 1 for r in got.values())
    return got, [(got[r.doc_id].score, r[label]) for r in labels if r.doc_id in got and got[r.doc_id].held_out]


def test_toxicity(spark):
    got, pairs = held(spark, "op1_toxicity", "toxic")
    assert auc(pairs) > 0.85 and all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_quality(spark):
    got, pairs = held(spark, "op7_quality_model", "quality")
    assert auc(pairs) > 0.75 and all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_risk_against_a_plain_loop():
    """Both branches of the non-negative risk, its slopes by small differences, and gradients of rows by their dense form."""
    rng = np.random.default_rng(5)
    plain = lambda g, y: np.log(1 + np.exp(-g if y else g))
    for shift, prior in ((0.0, 0.4), (3.0, 0.9)):
        gp, gu = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 9)
        minus = lambda p, u: sum(plain(g, 0) for g in u) / 9 - prior * sum(plain(g, 0) for g in p) / 7  # noqa: B023, E731
        plus = lambda p: prior * sum(plain(g, 1) for g in p) / 7  # noqa: B023, E731
        got = quality_model.risk(gp, gu, prior)
        assert np.allclose(got[:2], (plus(gp), minus(gp, gu)))
        assert (got[1] < 0) == (shift > 0)  # both branches are met
        goal = (lambda p, u: plus(p) + minus(p, u)) if shift == 0 else (lambda p, u: -minus(p, u))  # noqa: B023
        for g, slopes, of in ((gp, got[2], lambda x: goal(x, gu)), (gu, got[3], lambda x: goal(gp, x))):  # noqa: B023
            for i in range(len(g)):
                up, down = g.copy(), g.copy()
                up[i], down[i] = g[i] + 1e-5, g[i] - 1e-5
                assert abs((of(up) - of(down)) / 2e-5 - slopes[i]) < 1e-6
    rows = quality_model.Rows(np.array([[0, 3], [1, 2], [0, 2]]), [[5, 9], [], [9]], 4)
    dense = np.zeros((3, 4 + quality_model.BUCKETS))
    for i, (cells, words) in enumerate((((0, 3), (5, 9)), ((1, 2), ()), ((0, 2), (9,)))):
        dense[i, list(cells)] = 1
        dense[i, [4 + w for w in words]] = 1 / np.sqrt(max(1, len(words)))
    w, by_row = rng.normal(size=dense.shape[1]), rng.normal(size=3)
    assert np.allclose(rows.margin(w), dense @ w) and np.allclose(rows.gradient(by_row), by_row @ dense)
    assert np.allclose(rows.half(0).margin(w), (dense @ w)[[0, 2]])


def test_prior_and_labels_of_zero(spark):
    """The prior is found without labelled negatives, whose labels change nothing, nor does the layout of rows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = quality_model.fit(docs, labels)
    two = quality_model.fit(docs.repartition(7, "text"), labels.filter("quality = 1").repartition(3))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias and np.array_equal(one.levels, two.levels)
    assert abs(one.prior - np.mean([r.quality for r in labels.collect()])) < 0.08


@pytest.mark.parametrize("hot", [0, 8, 512])
def test_nearest_examples_are_exact(hot, monkeypatch):
    monkeypatch.setattr(toxicity, "HOT", hot)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        terms = np.sort(rng.choice(60, rng.integers(0, 12), replace=False))
        w = rng.random(len(terms))
        vectors.append((terms, w / np.sqrt((w * w).sum()) if len(w) else w))
    index = toxicity.Index(vectors, list(range(300)), rng.integers(0, 2, 300).tolist(), 60)
    dense = np.zeros((300, 60))
    for p, i in enumerate(index.ids):
        dense[p, vectors[i][0]] = vectors[i][1]
    for terms, w in vectors[:80]:
        q = np.zeros(60)
        q[terms] = w
        cosine = dense @ q
        found, score = index.nearest(terms, w, 15)
        want = np.sort(cosine[cosine > 0])[::-1][:15]
        assert np.allclose(score, want) and np.allclose(cosine[found], score)


def test_toxicity_against_brute_force(spark):
    """Cosines over all words of whole texts, with document frequencies counted here, for every held-out document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: toxicity.words_of(r.text) for r in docs.collect()}
    words, index = list(model.space.place), model.index
    examples = [rows[i] for i in index.ids.tolist()]
    assert set(words) == set().union(*examples)
    df = np.array([sum(w in x for x in rows.values()) for w in words])
    weight = (np.log((1 + len(rows)) / (1 + df)) + 1e-3) * toxicity.tells(words, examples, index.labels.tolist())

    def vector(x):
        v = np.array([(1 + np.log(x[w])) if w in x else 0.0 for w in words]) * weight
        return v / max(1e-300, np.sqrt((v * v).sum()))

    dense = np.stack([vector(x) for x in examples])
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).filter("held_out").collect()}
    for i, r in got.items():
        cosine = dense @ vector(rows[i])
        near = [p for p in np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12))) if cosine[p] > 0][: toxicity.NEIGHBOURS]
        assert abs(r.score - model.score(model.vote(np.array(near, int), cosine[near]))) < 1e-6
        assert np.allclose(sorted(cosine[[index.ids.tolist().index(e) for e in r.evidence]]), sorted(cosine[near[:3]]))
        assert bool(r.evidence) == bool(set(words) & set(rows[i]))


def test_odd_rows(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i in (5, 6)), 1.0) for i in range(14)] + [(3, None, None, 2.0), (None, 1, 1, 1.0)], "doc_id long, quality int, toxic int, text double")
    for module, run, fit in ((toxicity, toxicity.score_toxicity, toxicity.fit), (quality_model, quality_model.score_quality, quality_model.fit)):
        for some in (labels, labels.limit(0)):
            out = run(df, fit(df, some)).collect()
            assert len(out) == df.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in out), module
        assert run(odd_docs(spark, 0), fit(odd_docs(spark, 0), labels)).count() == 0
