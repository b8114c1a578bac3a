"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 that may teach; the unlabelled side is web text drawn without looking at labels. Rows labelled otherwise teach nothing.
The class prior is estimated from both sides: no part of the unlabelled texts that looks like positives can be smaller than the prior's share of the positives there. A
logistic model then minimises the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The probability of a positive at a
margin is, by Bayes' rule, the prior times the share of positives there over the share of unlabelled texts there, made rising.
"""

from __future__ import annotations

import zlib
from math import log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import draw_order, learns, map_texts

#: Bounds of what is learnt from: trusted positives and unlabelled texts, the first of each in a fixed pseudo-random order.
POSITIVES, UNLABELLED = 4_000, 6_000
#: Each measure of a text is cut at its deciles into one-hot cells; its different words fall into BUCKETS hashed features, which together weigh as much as one cell.
CUTS, BUCKETS = 10, 1 << 14
#: Steps of the risk's minimisation, and how much weights are held back: those of cells, and those of words.
STEPS, DECAY, WORD_DECAY = 250, 1e-4, 1e-2
#: Ranges of the margin for which the probability is estimated (of 50 positives at least), and how much of a score is the sigmoid of the margin, which keeps the order within a range.
RANGES, PLAIN = 64, 0.02
#: The prior is estimated where at least this share of the held-out positives lies.
TAIL = 0.25
_KIND = np.full(256, 5, np.uint8)  # other
for _at, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:'\"-()?")):
    _KIND[[ord(c) for c in _chars]] = _at
for _at, _c in enumerate("!#*$%&|<>", 6):
    _KIND[ord(_c)] = min(_at, 8)
_KIND[[ord("|"), ord("<"), ord(">")]] = 9
MEASURES = ["words", "characters", "word length", "lower", "upper", "digits", "marks", "other", "!", "#", "symbols", "pipes", "different words", "longest word", "lines", "words a line", "repeated lines", "ended lines", "commonest word", "different pairs"]


def measures(text: str | None) -> list[float]:
    """A text's make-up. Each is a plain ratio or a logarithm; an empty text has zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(raw)
    if not n:
        return [0.0] * len(MEASURES)
    kinds = np.zeros(10)
    for at in range(0, chars, 1 << 20):
        kinds += np.bincount(_KIND[np.frombuffer(raw[at : at + (1 << 20)], np.uint8)], minlength=10)
    solid = max(1.0, chars - kinds[3])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = kinds / solid
    return [
        log1p(n), log1p(chars), solid / n, share[0], share[1], share[2], share[4], share[5], share[6], share[7], share[8], share[9], len(counts) / n, float(max(map(len, counts))), log1p(len(lines)), n / len(lines),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), max(counts.values()) / n, len(set(zip(words, words[1:]))) / max(1, n - 1),
    ]


def buckets(text: str | None) -> list[int]:
    """The hashed features of a text's different words, in lower case and without marks around them."""
    words = {w.strip(b".,;:!?\"'()[]{}*#$%&|<>") for w in (text or "").lower().encode("utf-8", "surrogatepass").split()}
    return sorted({zlib.crc32(w) % BUCKETS for w in words if w})


class Rows:
    """What the model sees of texts: the cells of their measures, and their words' buckets as runs of one array."""

    def __init__(self, cells: np.ndarray, words: list[list[int]], size: int):
        """size: of all cells; buckets are numbered from there on."""
        self.cells, self.size = cells, size
        many = np.array([len(x) for x in words], np.int64)
        self.words = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in words)]).astype(np.int64) + size
        self.owner, self.value = np.repeat(np.arange(len(words)), many), np.repeat(1 / np.sqrt(np.maximum(1, many)), many)

    def __len__(self) -> int:
        return len(self.cells)

    def margin(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.cells].sum(axis=1) + np.bincount(self.owner, weights[self.words] * self.value, len(self))

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        """The sum over rows of by_row times the row's features."""
        cells = np.bincount(self.cells.ravel(), np.repeat(by_row, self.cells.shape[1]), self.size + BUCKETS)
        return cells + np.bincount(self.words, by_row[self.owner] * self.value, self.size + BUCKETS)

    def half(self, odd: int) -> Rows:
        at = np.arange(len(self)) % 2 == odd
        out = Rows(self.cells[at], [], self.size)
        mine = at[self.owner]
        out.words, out.value, out.owner = self.words[mine], self.value[mine], (np.cumsum(at) - 1)[self.owner[mine]]
        return out


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """For margins of positives and unlabelled texts: the positives' and the negatives' part of the unbiased risk, and the steps' gradients by margin. Where the negatives'
    part is below zero, which no true risk is, the step goes back on it, as the non-negative estimator asks."""
    plus = prior * np.logaddexp(0, -gp).mean()
    minus = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    sp, su = _sigmoid(gp), _sigmoid(gu)
    dp, du = (prior * (sp - 1) - prior * sp, su) if minus >= 0 else (prior * sp, -su)
    return plus, minus, dp / len(gp), du / len(gu)


def minimised(p: Rows, u: Rows, slopes, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam, from slopes(margins of p, margins of u), the gradients by margin."""
    size = p.size + BUCKETS
    decay = np.where(np.arange(size) < p.size, DECAY, WORD_DECAY)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        dp, du = slopes(p.margin(w[:-1]) + w[-1], u.margin(w[:-1]) + w[-1])
        g = np.append(p.gradient(dp) + u.gradient(du) + decay * w[:-1], dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (0.05 * (1 - step / (steps + 1)) + 1e-3) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(p: Rows, u: Rows) -> float:
    """The share of positives in unlabelled text. A classifier tells half of each side apart; of the other halves the share of unlabelled texts that score above a level is
    at least the prior times that of positives, and the least ratio over all levels is the estimate."""

    def apart(gp: np.ndarray, gu: np.ndarray):
        return (_sigmoid(gp) - 1) / len(gp), _sigmoid(gu) / len(gu)

    w, _ = minimised(p.half(0), u.half(0), apart, STEPS // 4)
    sp, su = np.sort(p.half(1).margin(w)), np.sort(u.half(1).margin(w))
    if not len(sp) or not len(su):
        return 0.5
    levels = sp[: max(1, int((1 - TAIL) * len(sp)))]
    ratio = (1 - np.searchsorted(su, levels) / len(su)) / (1 - np.searchsorted(sp, levels) / len(sp))
    return float(np.clip(ratio.min(), 0.01, 0.99))


def probabilities(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, probability of a positive) to interpolate between: prior * share of positives / share of unlabelled texts in ranges of the margin, with neighbours
    that fall pooled."""
    edges = np.unique(np.quantile(np.concatenate((gp, gu)), np.linspace(0, 1, max(2, min(RANGES, len(gp) // 50)) + 1)[1:-1]))
    np_, nu = (np.bincount(np.searchsorted(edges, g, side="right"), minlength=len(edges) + 1) / len(g) for g in (gp, gu))
    middle = np.concatenate((edges[:1], (edges[1:] + edges[:-1]) / 2, edges[-1:])) if len(edges) else np.zeros(1)
    pools: list[list] = []
    for x, a, b in zip(middle, prior * np_, nu):
        pools.append([a, b, [x]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, xs = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + xs]
    levels = [min(1.0, a / b) if b else 1.0 for a, b, _ in pools]
    return np.array([x for *_, xs in pools for x in (xs[0], xs[-1])]), np.repeat(levels, 2)


class Model:
    def __init__(self, positive: list[tuple[list[float], list[int]]], unlabelled: list[tuple[list[float], list[int]]], prior: float | None = None):
        """Measures and buckets of each text; the class prior is estimated unless it is given."""
        both = np.array([x for x, _ in positive + unlabelled])
        self.cuts = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(both.shape[1])]
        self.starts = np.cumsum([0] + [len(c) + 1 for c in self.cuts])[:-1]
        self.size = int(sum(len(c) + 1 for c in self.cuts))
        p, u = self.rows(positive), self.rows(unlabelled)
        self.prior = class_prior(p, u) if prior is None else prior
        self.weights, self.bias = minimised(p, u, lambda gp, gu: risk(gp, gu, self.prior)[2:])
        self.steps, self.levels = probabilities(self.margin(p), self.margin(u), self.prior)

    def rows(self, texts: list[tuple[list[float], list[int]]]) -> Rows:
        x = np.array([m for m, _ in texts]).reshape(len(texts), len(self.cuts))
        cells = np.stack([np.searchsorted(c, x[:, j], side="right") + s for j, (c, s) in enumerate(zip(self.cuts, self.starts))], axis=1)
        return Rows(cells, [b for _, b in texts], self.size)

    def margin(self, rows: Rows) -> np.ndarray:
        return rows.margin(self.weights) + self.bias

    def score(self, texts: list[tuple[list[float], list[int]]]) -> np.ndarray:
        g = self.margin(self.rows(texts))
        return (1 - PLAIN) * np.interp(g, self.steps, self.levels) + PLAIN * _sigmoid(g)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _seen(df: DataFrame) -> DataFrame:
    """(k, h, x, b) of (k, h, t): measures and buckets of each text."""
    return map_texts(df.select("k", "h", "t"), lambda: lambda ids, hashes, texts: [ids, hashes, [measures(t) for t in texts], [buckets(t) for t in texts]], "k long, h long, x array<double>, b array<int>")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", mod: int = 5, held: int = 0) -> Model | None:
    """Learn from labels of 1 whose id may teach (crc32 mod `mod` is not `held`), POSITIVES of them at most, and from at most UNLABELLED texts of df, whatever their labels.

    Both are the first in a fixed pseudo-random order of ids and texts, so the model doesn't depend on how rows are laid out; the driver gets what the model sees of
    these texts. Rows that repeat an id and a text count once. Without a positive or an unlabelled text there is no model.
    """
    spark = df.sparkSession
    trusted = labels.filter(F.col(label_col).cast("int") == 1).select(F.col(label_id).cast("long").alias("k")).filter(learns(F.col("k"), mod, held)).distinct()
    trusted = F.broadcast(spark.createDataFrame(trusted.orderBy(*draw_order("k")).limit(POSITIVES).collect(), "k long"))
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    drawn = spark.createDataFrame(docs.select("k", "h").distinct().orderBy(*draw_order("k", "h")).limit(UNLABELLED).collect(), "k long, h long")
    loose = docs.join(F.broadcast(drawn.withColumnsRenamed({"k": "k2", "h": "h2"})), F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left_semi")
    found = [sorted({(r.k is not None, r.k or 0, r.h): (r.x, r.b) for r in _seen(rows).collect()}.items()) for rows in (docs.join(trusted, "k", "left_semi"), loose)]
    positive, unlabelled = ([x for _, x in rows] for rows in found)
    return Model(positive, unlabelled) if positive and unlabelled else None


def score_quality(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, mod: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    score: the model's probability of quality 1 for the whole text (0.5 where there is no model; null and empty texts are scored as texts without words);
    predicted: 1 if the score is at least `threshold`; held_out: the id does not teach, null ids included. Repeated rows each return a row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a weight for each cell and bucket
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (~learns(F.col(id_col), mod, held)).alias("held_out"), F.col(text_col).cast("string").alias("t"))

    def make():
        model = shared.value

        def fn(ids, held_out, texts):
            s = model.score([(measures(t), buckets(t)) for t in texts]) if model else np.full(len(texts), 0.5)
            return [ids, held_out, s.tolist()]

        return fn

    return map_texts(rows, make, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
