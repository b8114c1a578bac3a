"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives a vector a string of BITS hash bits (the sides of random planes) and keeps the strings in a sorted array. A query goes down each array to
the strings that share its longest prefix, and then up all trees together, one bit at a time, until the rows that share a prefix of that length with it in some tree
are enough. Those are compared by their exact distance.

In Spark a sorted array is cut into segments of some thousand strings. Queries meet only the segments that their prefix ranges touch. Equal vectors are one entry,
with the smallest ids that can matter, so a vector that a third of all rows repeat costs no more than any other. Different vectors of one string can't be told apart by
a cut; a segment that they make too large is dealt out in parts by hash, and queries meet every part.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, draw_order

TREES, BITS = 16, 40
#: Strings of a segment, and segments at most (they grow instead).
SEGMENT, SEGMENTS = 4096, 50_000
#: Vectors that centres and planes' middles are taken from, and queries on which the ascent is set so that the share AIM of true neighbours is met.
SAMPLE, TUNE, AIM = 4096, 64, 0.96


class Planes:
    """Hash strings as numbers, by dimension; the same planes everywhere."""

    def __init__(self, sample: dict[int, np.ndarray], trees: int, seed: int = 7):
        self.sample, self.trees, self.seed, self.made = {d: (x.mean(0), x) for d, x in sample.items()}, trees, seed, {}

    def of(self, dim: int):
        if dim not in self.made:
            planes = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.trees * BITS))
            centre, x = self.sample.get(dim, (np.zeros(dim), np.zeros((1, dim))))
            self.made[dim] = planes, centre, np.median((x - centre) @ planes, axis=0)
        return self.made[dim]

    def strings(self, x: np.ndarray) -> np.ndarray:
        """rows x trees"""
        planes, centre, middle = self.of(x.shape[1])
        bits = ((x - centre) @ planes > middle).reshape(len(x), self.trees, BITS)
        return bits @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


def _vectors(raw) -> np.ndarray:
    return np.array([np.frombuffer(b, "<f8") for b in raw]) if len(raw) else np.zeros((0, 1))


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix."""
    return BITS - np.frexp((a ^ b).astype(float))[1]


def _packed(batches):
    """Column v, the last one, as bytes of doubles, and its length."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        vec = pa.array([np.array(x, "<f8").tobytes() for x in lists.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], vec, pa.array([len(x) for x in lists], pa.int32())], names=[*b.schema.names[:-1], "vec", "dim"])


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(v, id): each pair of a usable vector and an id once."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable)
    return rows.groupBy("v", "id").agg(F.lit(1).alias("one")).drop("one")


def classes_of(df: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, ids, vec, dim): each different usable vector with the smallest of its ids and its k + 1 smallest ids; vec as bytes of doubles."""
    rows = _usable(df, id_col, vec_col)
    # The rank limit holds within each task first, so a task sends k + 1 rows of a vector at most, whichever way it is repeated.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    some = rows.select("v", "id", nth.alias("n")).filter(F.col("n") <= k + 1)
    one = some.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    return one.select("id", "ids", "v").mapInArrow(_packed, "id long, ids array<long>, vec binary, dim int")


def search(df: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, id_col: str = "vec_id", vec_col: str = "embedding", aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of `queries` (id and vector under the same names), by Euclidean distance in double precision,
    nearest first, ties to the smaller id; a row of the query's own id is no candidate. Fewer rows if there are fewer candidates.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id. Vectors are compared with those of their own
    length. Repeated rows count once; an id with different vectors is found by each. An empty table gives no row. Other columns are left out.
    """
    spark = df.sparkSession
    classes = as_table(classes_of(df, k, id_col, vec_col).withColumn("key", F.xxhash64("vec", "id")))
    ask = as_table(_usable(queries, id_col, vec_col).select(F.col("id").alias("q"), "v").mapInArrow(_packed, "q long, vec binary, dim int"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = classes.count()
    if not n or ask.isEmpty():
        return empty
    sample: dict[int, list] = {}
    for r in classes.orderBy(*draw_order("id")).select("vec", "dim").limit(SAMPLE).collect():
        sample.setdefault(r.dim, []).append(r.vec)
    planes = spark.sparkContext.broadcast(Planes({d: _vectors(x) for d, x in sample.items()}, trees))

    def hashes(columns: list[str], fences=None):
        """Rows of each tree with their string; with fences, with their segment too."""

        def run(batches):
            for b in batches:
                dims = np.array(b.column("dim"))
                for dim in np.unique(dims):
                    part = b.filter(pa.array(dims == dim))
                    h = planes.value.strings(_vectors(part.column("vec").to_pylist()))
                    for t in range(h.shape[1]):
                        out = [part.column(c) for c in columns] + [pa.array(np.full(len(h), t, np.int32)), pa.array(h[:, t])]
                        if fences is not None:
                            out.append(pa.array(fences.value.home(int(dim), t, h[:, t])))
                        yield pa.RecordBatch.from_arrays(out, names=[*columns, "tree", "h", *(["seg"] if fences is not None else [])])

        return run

    # Segments: quantiles of each tree's strings, from mergeable sketches.
    cut = max(1, min(ceil(n / SEGMENT), SEGMENTS // trees))
    marks = classes.mapInArrow(hashes(["dim"]), "dim int, tree int, h long").groupBy("dim", "tree").agg(F.percentile_approx("h", [i / cut for i in range(1, cut)] or [0.5], 20_000).alias("at"))
    found = {(r.dim, r.tree): sorted(set(r["at"])) if cut > 1 else [] for r in marks.collect()}
    fences = spark.sparkContext.broadcast(Fences(found))
    index = classes.mapInArrow(hashes(["id", "key", "vec"], fences), "id long, key long, vec binary, tree int, h long, seg int")
    counts = {r.seg: r["count"] for r in classes.mapInArrow(hashes(["dim"], fences), "dim int, tree int, h long, seg int").groupBy("seg").count().collect()}
    sizes = spark.sparkContext.broadcast(fences.value.sums(counts))
    # (segment, parts) of those that hold several times their share; few, as each holds more than 4 * SEGMENT strings.
    large = spark.createDataFrame([(seg, ceil(c / SEGMENT)) for seg, c in counts.items() if c > 4 * max(SEGMENT, n / cut)], "seg int, parts int")
    large = F.broadcast(large)

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows of the index in the parts of their segment."""
        return rows.join(large, "seg", "left").withColumn("part", F.coalesce(F.pmod("key", F.col("parts")), F.lit(0)).cast("int")).drop("parts")

    def everywhere(rows: DataFrame) -> DataFrame:
        """Rows of queries in every part of the segment that they meet."""
        return rows.join(large, "seg", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")

    # Down: in its home segment each query counts the strings that share each length of prefix; beyond the segment whole segments count, and parts of them by their share.
    homes = ask.mapInArrow(hashes(["q", "dim"], fences), "q long, dim int, tree int, h long, seg int")
    index = dealt(index)
    strings = index.select("seg", "part", "h")

    def down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"q": [], "dim": [], "tree": [], "h": [], "n": []}, dtype=object)
        h = np.sort(left["h"].to_numpy(np.int64))
        out = []
        for q, dim, t, x, part in zip(right["q"], right["dim"], right["tree"], right["h"], right["part"]):
            out.append((q, dim, t, x, fences.value.counts(int(dim), int(t), int(x), h, None if part else sizes.value)))  # other segments count once
        return pd.DataFrame(out, columns=["q", "dim", "tree", "h", "n"])

    counted = as_table(strings.groupBy("seg", "part").cogroup(everywhere(homes).groupBy("seg", "part")).applyInPandas(down, "q long, dim int, tree int, h long, n array<double>"))
    level_of = _tune(classes, ask, counted, planes, k, aim)

    # Up, all trees together: the longest prefix that enough strings share.
    total = counted.select("q", "dim", F.posexplode("n").alias("bits", "n")).groupBy("q", "dim", "bits").agg(F.sum("n").alias("n"))
    level = total.filter((F.col("n") >= level_of) | (F.col("bits") == 0)).groupBy("q", "dim").agg(F.max("bits").alias("bits"))

    def touch(batches):
        for b in batches:
            rows = b.to_pydict()
            where = [fences.value.touched(d, t, h, x) for d, t, h, x in zip(rows["dim"], rows["tree"], rows["h"], rows["bits"])]
            many = np.repeat(np.arange(b.num_rows), [len(w) for w in where])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(many)) for c in ("q", "h", "bits", "vec")), pa.array(np.concatenate([*where, np.zeros(0, np.int32)]).astype(np.int32))], names=["q", "h", "bits", "vec", "seg"])

    routed = counted.select("q", "dim", "tree", "h").distinct().join(level, ["q", "dim"]).join(ask, ["q", "dim"]).select("q", "dim", "tree", "h", "bits", "vec")
    routed = routed.mapInArrow(touch, "q long, h long, bits int, vec binary, seg int")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            order = np.argsort(left["h"].to_numpy(np.int64), kind="stable")
            h, ids, keys, x = left["h"].to_numpy(np.int64)[order], left["id"].to_numpy(np.int64)[order], left["key"].to_numpy(np.int64)[order], _vectors(left["vec"].tolist())[order]
            for q, s, bits, raw in zip(right["q"], right["h"], right["bits"], right["vec"]):
                low = (int(s) >> (BITS - int(bits))) << (BITS - int(bits))
                a, b = np.searchsorted(h, [low, low + (1 << (BITS - int(bits)))])
                if a < b:
                    d = x[a:b] - np.frombuffer(raw, "<f8")
                    d = np.sqrt(np.einsum("ij,ij->i", d, d))
                    if len(d) > k + 1:
                        near = np.flatnonzero(d <= np.partition(d, k)[k])
                    else:
                        near = np.arange(len(d))
                    near = near[np.lexsort((ids[a:b][near], d[near]))][: k + 1]
                    out.append(pd.DataFrame({"q": q, "key": keys[a:b][near], "score": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "key": [], "score": []})

    hits = index.groupBy("seg", "part").cogroup(everywhere(routed).groupBy("seg", "part")).applyInPandas(nearest, "q long, key long, score double")
    hits = hits.groupBy("q", "key").agg(F.min("score").alias("score"))
    rows = hits.join(classes.select("key", "ids"), "key").select("q", "score", F.explode("ids").alias("vec_id")).filter("q != vec_id").groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return rows.select(F.col("q").alias("query_id"), rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


class Fences:
    """Where each tree's segments begin. Segments have numbers over all dimensions and trees."""

    def __init__(self, at: dict[tuple[int, int], list[int]]):
        self.at, self.first, n = {}, {}, 0
        for key in sorted(at):
            self.at[key], self.first[key] = np.array(at[key], np.int64), n
            n += len(at[key]) + 1

    def home(self, dim: int, tree: int, h: np.ndarray) -> np.ndarray:
        if (dim, tree) not in self.at:
            return np.full(len(h), -1, np.int32)
        return (self.first[dim, tree] + np.searchsorted(self.at[dim, tree], h, side="right")).astype(np.int32)

    def touched(self, dim: int, tree: int, h: int, bits: int) -> np.ndarray:
        if (dim, tree) not in self.at:
            return np.zeros(0, np.int32)
        low = (h >> (BITS - bits)) << (BITS - bits)
        a, b = self.home(dim, tree, np.array([low, low + (1 << (BITS - bits)) - 1]))
        return np.arange(a, b + 1, dtype=np.int32)

    def sums(self, sizes: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
        """By dimension and tree: the strings before each segment, and all of them."""
        return {k: np.concatenate(([0], np.cumsum([sizes.get(self.first[k] + i, 0) for i in range(len(at) + 1)]))) for k, at in self.at.items()}

    def counts(self, dim: int, tree: int, h: int, own: np.ndarray, sums: dict[tuple[int, int], np.ndarray] | None) -> np.ndarray:
        """How many strings share 0, 1, ... BITS bits with h: exact within its own segment (the sorted strings `own`); of others the share of their range that lies in
        the prefix's, by sums up to either end. Without sums only the own segment counts."""
        free = BITS - np.arange(BITS + 1, dtype=np.int64)
        low = (np.int64(h) >> free) << free
        high = low + (np.int64(1) << free)
        inside = np.searchsorted(own, high) - np.searchsorted(own, low).astype(float)
        if sums is None or (dim, tree) not in self.at:
            return inside
        edges = np.concatenate(([0], self.at[dim, tree], [1 << BITS])).astype(float)
        home = int(np.searchsorted(self.at[dim, tree], h, side="right"))
        below = lambda x: np.interp(x.astype(float), edges, sums[dim, tree])
        mine = below(np.minimum(high, edges[home + 1])) - below(np.maximum(low, edges[home]))
        return inside + below(high) - below(low) - mine


def _tune(classes: DataFrame, ask: DataFrame, counted: DataFrame, planes, k: int, aim: float) -> float:
    """How many strings the ascent must reach, by exact neighbours of TUNE queries over all rows: so many as the prefix length has at which the share `aim` of those
    neighbours share it with their query in some tree."""
    tune = ask.orderBy(*draw_order("q")).limit(TUNE).collect()
    shared = ask.sparkSession.sparkContext.broadcast([(r.q, r.vec) for r in tune])

    def exact(batches):
        for b in batches:
            raw, ids = b.column("vec").to_pylist(), np.array(b.column("id"))
            dims = np.array(b.column("dim"))
            for q, v in shared.value:
                same = np.flatnonzero(dims == len(v) // 8)
                if not len(same):
                    continue
                d = _vectors([raw[i] for i in same]) - np.frombuffer(v, "<f8")
                d = np.einsum("ij,ij->i", d, d)
                d[ids[same] == q] = np.inf
                near = np.argsort(d, kind="stable")[:k]
                near = near[np.isfinite(d[near])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(d[near]), pa.array([raw[i] for i in same[near]], pa.binary())], names=["q", "d", "vec"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    true = classes.select("id", "vec", "dim").mapInArrow(exact, "q long, d double, vec binary").select("q", "vec", nth.alias("n")).filter(F.col("n") <= k).collect()
    own, best = {r.q: r.vec for r in tune}, []
    for r in true:
        h = planes.value.strings(_vectors([own[r.q], r.vec]))
        best.append(int(_shared_bits(h[0], h[1]).max()))
    if not best:
        return 1.0
    best = np.array(best)
    bits = max(x for x in range(BITS + 1) if (best >= x).mean() >= aim)
    at = counted.filter(F.col("q").isin([r.q for r in tune])).groupBy("q").agg(F.sum(F.get("n", F.lit(bits))).alias("n")).collect()
    return max(float(k + 1), float(np.median([r.n for r in at])))
