"""Near-duplicates by circulant MinHash: two permutations make all coordinates of a signature.

The first permutation scatters a text's shingles over a ring of 2^RING places. The second gives each place a rank, and coordinate k is the least rank after turning the
ring by k places: one gather of COORDS neighbouring ranks a shingle, and their minimum over the shingles, instead of a hash function for each coordinate. Signatures are cut
into bands; texts that share a band are candidates, and links are confirmed on the full sets of shingles.

Texts of one set are one class. No bucket is paired off in full: each class first meets its buckets' heads, confirmed links join components, and only classes of different
components that share a bucket are compared further, if their signatures don't rule a link out.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, broadcast_if_small, map_texts
from vinlake.llm.simhash import Shingles, _mixed, connected

#: Places of the ring (a power of two), coordinates of a signature, and bands and coordinates of a band. A pair of similarity 0.85 shares no band with a chance of 2e-9.
RING, COORDS, BANDS, BAND = 22, 1024, 42, 6
#: Of two signatures' lowest bits so many may differ: 77 do on average at a similarity of 0.85, with a deviation of 8.4, and 127 at 0.75. More do with a chance of 2e-9.
MOST_BITS = 127
#: Shingles gathered at once, and rows (of a band or a class) that are broadcast at most.
BLOCK, MAX_BROADCAST = 64, 200_000
WORDS = tuple(f"b{i}" for i in range(COORDS // 64))


@lru_cache(1)
def _permutations(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view of the second whose row p holds the ranks of the places p, p + 1, ... on the ring."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(np.arange(1 << RING, dtype=np.uint32))
    ranks = rng.permutation(np.arange(1 << RING, dtype=np.uint32))
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: COORDS - 1]]), COORDS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDS coordinates of a set of shingles (64-bit hashes)."""
    first, turned = _permutations()
    at = first[(shingles >> np.uint64(64 - RING)).astype(np.int64)]
    least = np.full(COORDS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), BLOCK):
        np.minimum(least, turned[at[i : i + BLOCK]].min(axis=0), out=least)
    return least


def _bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    bands = sig[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return h.view(np.int64)


def _set_hash(shingles: np.ndarray) -> int:
    """A hash of a set, whatever its order, as a signed number."""
    return int(np.bitwise_xor.reduce(_mixed(shingles + np.uint64(len(shingles)))).astype(np.uint64).view(np.int64)) if len(shingles) else 0


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, c, n, keys, b0, b1, ...) of docs (doc_id, th, t): the class and size of a text's set of shingles, its signature's lowest bits and its bands' keys."""

    def make():
        shingles = Shingles()

        def fn(ids, hashes, texts):
            sets = [shingles.of(shingles.words(t), width) for t in texts]
            sigs = [signature(x) if len(x) else np.zeros(COORDS, np.uint32) for x in sets]
            bits = [np.packbits((s & 1).astype(np.uint8), bitorder="little").view("<i8").tolist() for s in sigs]
            keys = [_bands(s) if len(x) else [] for s, x in zip(sigs, sets)]
            return [ids, hashes, [_set_hash(x) for x in sets], [len(x) for x in sets], keys, *(list(b) for b in zip(*bits))]

        return fn

    return map_texts(docs, make, "doc_id long, th long, c long, n long, keys array<long>, " + ", ".join(f"{w} long" for w in WORDS))


def _overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of classes with the sizes `common` and `either` of their sets' intersection and union. docs: (th, t), texts by their hash; classes: (c, th)."""
    pairs = as_table(pairs.distinct())
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    some = as_table(classes.join(broadcast_if_small(ids, MAX_BROADCAST), "c", "left_semi").select("c", "th"))
    found = docs.join(broadcast_if_small(some.select("th").distinct(), MAX_BROADCAST), "th", "left_semi").dropDuplicates(["th"]).join(some, "th")

    def packed():
        shingles = Shingles()

        def fn(ids, texts):
            return [ids, [shingles.of(shingles.words(t), width).tobytes() for t in texts]]

        return fn

    sets = as_table(map_texts(found.select("c", "t"), packed, "c long, s binary"))
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")

    def compare():
        def fn(a, b, sa, sb):
            sets = [[np.frombuffer(x, np.uint64) for x in s] for s in (sa, sb)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
            return [a, b, common, [len(x) + len(y) - n for x, y, n in zip(*sets, common)]]

        return fn

    return map_texts(both.select("a", "b", "sa", "sb"), compare, "a long, b long, common long, either long", rows=64)


def _may_link(percent: int) -> Column:
    """Whether sizes and signatures of the classes x and y allow a link."""
    sizes = 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
    bits = [F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in WORDS]
    return sizes & (sum(bits[1:4], bits[0]) <= MOST_BITS) & (sum(bits[1:], bits[0]) <= MOST_BITS)


def near_copies(df: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of df: documents are linked if 100 * intersection >= percent * union of their sets of word shingles.

    A-Z become lower case; words are runs of other than ASCII white space; a set holds the distinct shingles of `width` words, or with fewer words the whole sequence.
    component_id: the smallest id reachable over links, the row's own included; kept: whether that is the row's id.

    A document without words (null, empty or blank) has an empty set and is linked with nothing, so it is its own component. A null id takes part in links, but is no
    component_id unless all ids of its component are null; then component_id is null and the row kept. Repeated rows each return a row, and so do different texts of one id.
    Other columns, of whatever name, are left out. An empty table gives no row. `percent` below 85 needs shorter bands to find as many of the pairs.
    """
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
    rows = as_table(signatures(docs, width))
    docs = docs.select("th", "t")
    same = [F.min(x).alias(x) for x in ("n", "keys", *WORDS)]  # equal in all of a class
    classes = as_table(rows.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), *same))
    signed = lambda p: classes.select(*(F.col(x).alias(f"{p}{x}") for x in ("c", "n", *WORDS)))

    # Buckets of more than one class, and the head of each: the class of the smallest id.
    index = classes.select("c", F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"), F.explode("keys").alias("key"))
    heads = index.groupBy("key").agg(F.min(F.struct("least", "c")).alias("h"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    heads = broadcast_if_small(as_table(heads.select("key", F.col("h.c").alias("b"))), MAX_BROADCAST)
    shared = as_table(index.join(heads, "key").select("key", "c", "b"))
    star = shared.filter("c != b").select(F.col("c").alias("a"), "b").distinct()
    star = star.join(signed("x"), F.col("a") == F.col("xc")).join(signed("y"), F.col("b") == F.col("yc")).filter(_may_link(percent)).select("a", "b")
    link = 100 * F.col("common") >= percent * F.col("either")
    first = as_table(_overlaps(star, docs, classes, width).filter(link)).select("a", "b")

    # Buckets that are not of one component yet: pairs of different components, each at the first bucket that it shares.
    joined = connected(first)
    named = joined.union(joined.select(F.col("root").alias("node"), "root").distinct())
    tagged = as_table(shared.select("key", "c").join(named, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("root", "c").alias("g")))
    mixed = tagged.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 != g1").select("key")
    tagged = as_table(tagged.join(broadcast_if_small(as_table(mixed), MAX_BROADCAST), "key", "left_semi"))
    of_class = tagged.groupBy("c").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # BANDS at most
    left = as_table(tagged.join(of_class.join(classes.drop("keys"), "c"), "c").select("key", "c", "g", "n", "keys", *WORDS))
    a, b = (left.select("key", *(F.col(x).alias(f"{s}{x}") for x in ("c", "g", "n", "keys", *WORDS))) for s in ("x", "y"))
    at_first = F.array_min(F.array_intersect("xkeys", "ykeys")) == F.col("key")
    rest = a.join(b.hint("shuffle_hash"), "key").filter((F.col("xc") < F.col("yc")) & (F.col("xg") != F.col("yg")) & _may_link(percent) & at_first)
    second = as_table(_overlaps(rest.select(F.col("xc").alias("a"), F.col("yc").alias("b")), docs, classes, width).filter(link)).select("a", "b")

    star = connected(first.union(second))
    rooted = classes.select("c", "least").join(star, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "least")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(component, "root").select("c", "component_id")
    out = rows.filter("n > 0").select("doc_id", "n", "c").join(of_class, "c").select("doc_id", "n", "component_id")
    out = out.union(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
