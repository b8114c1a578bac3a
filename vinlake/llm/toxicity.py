"""Toxicity by the nearest labelled examples.

Labelled examples are unit vectors of TF-IDF weights over all their words. Examples stand in blocks of an inverted index that keeps, for each word and block, the
largest weight. A text's cosine with any example of a block is at most the sum of its weights times those, so blocks are visited from the highest bound down until no
block left can beat the k-th best cosine: the k nearest are exact. They vote by distance, and votes are calibrated by leaving each example out in turn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import draw_order, learns, map_texts

#: Bound of what is learnt from: examples of each label (the first in a fixed pseudo-random order), each as a whole.
EXAMPLES = 1_000
BLOCK, NEIGHBOURS = 32, 15
#: The words that the most examples hold. All blocks have them, so their largest weights rule nothing out: their weights stand in whole rows instead of postings.
HOT = 512
#: A word's weight is its TF-IDF times how well its presence tells the examples' labels apart: chi-square over chi-square + LEAST_CHI (chance, even among a million
#: words), and FLOOR at least, so that no word is without weight.
LEAST_CHI, FLOOR = 26.0, 0.02
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>"


def words_of(text: str | None) -> dict[str, int]:
    """The words of a text in lower case, without marks around them, with their numbers."""
    out: dict[str, int] = {}
    for w, n in Counter((text or "").lower().split()).items():
        w = w.strip(_STRIP)
        out[w] = out.get(w, 0) + n
    out.pop("", None)
    return out


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each run, one run after the other."""
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - begin, length)


class Index:
    """A block-max inverted index of examples' unit vectors. Both levels are sparse: a word has an entry for each block that holds it, an entry its postings. The HOT
    words' weights are a matrix, so what they add to the cosines of many texts is one product."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], labels: list[int], n_terms: int):
        # Examples of like heavy words stand together, so that a block's largest weights are close to its examples' own.
        order = sorted(range(len(ids)), key=lambda i: (labels[i], vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist(), ids[i]))
        self.ids, self.labels = np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], np.int64)
        self.n, self.blocks = len(order), -(-len(order) // BLOCK)
        terms = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)]).astype(np.int64)
        weights = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        owner = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        hot = np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[:HOT]
        self.row = np.full(n_terms, -1)
        self.row[hot] = np.arange(len(hot))
        is_hot = self.row[terms] >= 0
        self.rows = np.zeros((len(hot), self.n))
        self.rows[self.row[terms[is_hot]], owner[is_hot]] = weights[is_hot]
        terms, weights, owner = terms[~is_hot], weights[~is_hot], owner[~is_hot]
        by = np.lexsort((owner, terms))
        self.owner, self.weight = owner[by].astype(np.int32), weights[by]
        cell = terms[by] * max(1, self.blocks) + self.owner // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))  # where each entry's postings begin
        self.block = (cell[first] % max(1, self.blocks)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.postings = np.append(first, len(cell)).astype(np.int32)
        self.entries = np.searchsorted(terms[by][first], np.arange(n_terms + 1)).astype(np.int32)

    def hot(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the HOT words add to the cosine of each vector with each example."""
        query = np.zeros((len(vectors), len(self.rows)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            query[i, row[row >= 0]] = weights[row >= 0]
        return query @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine (ties: the smaller place), all with a word in common if fewer. without: an example that is left out; hot: from hot()."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        hot = self.hot([(terms, weights)])[0] if hot is None else hot
        begin = self.entries[terms]
        many = self.entries[terms + 1] - begin
        entry, weight = _runs(begin, many), np.repeat(weights, many)
        block = self.block[entry]
        starts = np.arange(0, self.n, BLOCK)
        bound = np.maximum.reduceat(hot, starts) + np.bincount(block, weight * self.most[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 8
        while at < len(order):
            if len(score) >= k and bound[order[at]] < score[k - 1] - 1e-12:
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[order[at : at + step]] = True
            some = np.flatnonzero(wanted[block])
            first = self.postings[entry[some]]
            length = self.postings[entry[some] + 1] - first
            place = _runs(first, length)
            cosine = hot + np.bincount(self.owner[place], self.weight[place] * np.repeat(weight[some], length), self.n)
            if without >= 0:
                cosine[without] = 0
            found = np.flatnonzero(np.repeat(wanted, BLOCK)[: self.n] & (cosine > 0))
            best, score = np.concatenate((best, found)), np.concatenate((score, cosine[found]))
            if len(score) > 4 * k:  # only what reaches the k-th best need be put in order
                some = score >= np.partition(score, len(score) - k)[len(score) - k]
                best, score = best[some], score[some]
            rank = np.lexsort((best, -score))[:k]
            best, score = best[rank], score[rank]
            at += step
            step = len(order)  # bounds that the nearest few blocks don't rule out are seldom ruled out by more
        return best, score


class Space:
    """Words with the weights that they have in vectors."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.place, self.weights = {w: i for i, w in enumerate(words)}, weights

    def unit(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that are known, and their weights (1 + ln tf) * weight, scaled to length 1."""
        place = self.place.get
        terms, n = np.array([place(w, -1) for w in counts], np.int64), np.array(list(counts.values()), float)
        terms, n = terms[terms >= 0], n[terms >= 0]
        w = (1 + np.log(n)) * self.weights[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w


def tells(words: list[str], examples: list[dict[str, int]], labels: list[int]) -> np.ndarray:
    """How well each word's presence tells the labels apart, from FLOOR to 1."""
    place = {w: i for i, w in enumerate(words)}
    df = np.zeros((2, len(words)))
    for x, y in zip(examples, labels):
        df[y, [place[w] for w in x]] += 1
    n, n1 = len(labels), sum(labels)
    a, b = df[1], df[0]
    c, d = n1 - a, n - n1 - b
    chi = n * (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * n1 * (n - n1))
    return np.maximum(FLOOR, chi / (chi + LEAST_CHI))


class Model:
    def __init__(self, ids: list[int], examples: list[dict[str, int]], labels: list[int], words: list[str], df: np.ndarray, n_docs: int, rate: float):
        """examples: their words and numbers; df: documents that hold each of `words`, of n_docs; rate: the share of label 1 among all teaching labels."""
        self.space = Space(words, (np.log((1 + n_docs) / (1 + df)) + 1e-3) * tells(words, examples, labels))
        vectors = [self.space.unit(x) for x in examples]
        self.index = Index(vectors, ids, labels, len(words))
        y = np.array(labels, float)
        # Each example counts as many rows as it stands for, so calibrated scores are true of all rows, not of the balanced sample.
        odds = (rate / max(1e-9, 1 - rate)) / max(1e-9, y.sum() / max(1, len(y) - y.sum())) if 0 < rate < 1 else 1.0
        place = {i: p for p, i in enumerate(self.index.ids.tolist())}
        votes = np.array([self.vote(*self.index.nearest(*v, NEIGHBOURS, place[i])) for v, i in zip(vectors, ids)])
        self.steps, self.levels = isotonic(votes, y, np.where(y == 1, odds, 1.0))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each with the weight 1 / (distance + 0.05), distance 1 - cosine; without neighbours -1."""
        if not len(found):
            return -1.0
        w = 1 / (1.05 - np.minimum(cosine, 1))
        return float((w * self.index.labels[found]).sum() / w.sum())

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, self.steps, self.levels), 0, 1))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of least weighted squares (pool adjacent violators), as points to interpolate between."""
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    pools: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        pools.append([float((w[at] * y[at]).sum()), float(w[at].sum()), float(v), float(v)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    steps = np.array([v for p in pools for v in (p[2], p[3] + 1e-12)])
    return steps, np.array([p[0] / p[1] for p in pools for _ in range(2)])


def _counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, words, numbers) of each row: the words of its whole text."""

    def make():
        def fn(ids, texts):
            found = [words_of(t) for t in texts]
            return [ids, [list(x) for x in found], [list(x.values()) for x in found]]

        return fn

    return map_texts(df.select(id_col, text_col), make, f"{id_col} long, words array<string>, numbers array<long>")


def document_frequencies(df: DataFrame, words: list[str], text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many texts of df hold each of the words, and how many rows df has. Each task sums up before the shuffle; a number a word reaches the driver."""
    shared = df.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # bounded by the words of the examples

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = shared.value, 0
        n = np.zeros(len(place), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, 256):
                for text in batch.slice(at, 256).column(0).to_pylist():
                    words = {w.strip(_STRIP) for w in set((text or "").lower().split())}
                    n[[place[w] for w in words if w in place]] += 1
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(n[held], rows))], names=["term", "n"])

    parts = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total, out = 0, np.zeros(len(words))
    for term, n in parts.collect():
        if term < 0:
            total = n
        else:
            out[term] = n
    return out, total


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", mod: int = 3, held: int = 1) -> Model | None:
    """Learn from labels whose id may teach (crc32 mod `mod` is not `held`).

    The words of at most EXAMPLES whole texts of each label reach the driver; document frequencies of all these words are counted over all of df, and the share of
    label 1 over all teaching labels. An id that is labelled both ways counts as the larger label. Without texts of both labels there is no model.
    """
    known = labels.select(F.col(label_id).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter(learns(F.col("i"), mod, held) & F.col("y").isin(0, 1))
    rate = known.agg(F.avg("y")).first()[0]
    if rate is None or not 0 < rate < 1:
        return None
    wanted = [r for y in (0, 1) for r in known.filter(F.col("y") == y).distinct().orderBy(*draw_order("i", "y")).limit(EXAMPLES).collect()]
    ids = df.sparkSession.createDataFrame(wanted, "k long, y int").groupBy("k").agg(F.max("y").alias("y"))
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    # Of rows that share an id the one of the smallest hash is the example.
    found = _counted(docs.join(F.broadcast(ids.select("k")), "k", "left_semi").groupBy("k").agg(F.min_by("t", F.xxhash64("t")).alias("t")), "k", "t")
    rows = sorted((r.k, r.y, dict(zip(r.words, r.numbers))) for r in found.join(F.broadcast(ids), "k").select("k", "y", "words", "numbers").collect() if r.words)
    words = sorted(set().union(*(x for *_, x in rows)))
    if not words or len({y for _, y, _ in rows}) < 2:
        return None
    frequency, n_docs = document_frequencies(df, words, text_col)
    return Model([i for i, _, _ in rows], [x for *_, x in rows], [y for _, y, _ in rows], words, frequency, n_docs, rate)


def score_toxicity(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row.

    score: the calibrated share of toxic votes among the NEIGHBOURS nearest examples of the whole text. A text without a word of any example (null and empty ones too)
    has no neighbour and gets what such examples scored, or the least score; without a model the score is 0. predicted: 1 if the score is at least `threshold`.
    evidence: the ids of the three nearest examples. held_out: the id does not teach, null ids included. Repeated rows each return a row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the words of 2 * EXAMPLES texts
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (~learns(F.col(id_col), mod, held)).alias("held_out"), F.col(text_col).cast("string").alias("t"))

    def make():
        model = shared.value

        def fn(ids, held_out, texts):
            if not model:
                return [ids, held_out, [0.0] * len(ids), [[]] * len(ids)]
            vectors = [model.space.unit(words_of(t)) for t in texts]
            near = [model.index.nearest(*v, NEIGHBOURS, hot=h) for v, h in zip(vectors, model.index.hot(vectors))]
            return [ids, held_out, [model.score(model.vote(*x)) for x in near], [model.index.ids[f[:3]].tolist() for f, _ in near]]

        return fn

    out = map_texts(rows, make, "doc_id long, held_out boolean, score double, evidence array<long>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
