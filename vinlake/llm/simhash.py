"""Near-duplicates by SimHash, found with pigeonring filtering.

A text becomes a fingerprint of 64 bits; texts whose fingerprints differ in at most `max_bits` bits are linked, and linked texts form components.
Copies share a fingerprint, so the search runs over distinct fingerprints only, however large a group of copies is.

Pigeonring: cut the 64 bits into m = max_bits + 1 segments on a ring. If two fingerprints differ in at most max_bits bits, some segment i starts a chain
whose first l segments differ in at most floor(l * max_bits / m) = l - 1 bits in total, for every l. So segment i is equal, segments i and i + 1 differ in one bit
at most, and so on. The first two links of the chain are the key of an equi-join (one side writes each one-bit change of its segment i + 1); the rest of the
chain prunes pairs before the full Hamming check. A key has 2 * 64 / m bits, so a block holds next to no pair that isn't a link.

`near_duplicates` links by fingerprints alone. `similar_texts` takes several families of fingerprints as a filter, and then compares the word shingles themselves:
at a similarity of 0.8 one fingerprint of 64 bits misses most pairs that any usable number of bits could find.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, broadcast_if_small, cut, map_texts

BITS = 64
#: Shingles hashed at once, which bounds memory for very long texts.
BLOCK = 65_536
#: Of similar_texts: fingerprints of a text, each of SEGMENTS segments; the ring that is checked in full spans CHECKED fingerprints, of which RING_BITS bits may differ.
FAMILIES, SEGMENTS, CHECKED, RING_BITS = 10, 4, 4, 48
#: Texts up to which a key of one segment keeps blocks small. Beyond it keys take bits of the next segment too, one for each doubling, and there are MORE times the
#: fingerprints for each bit, so that as many pairs of similarity 0.8 (of which some nine bits in 64 differ) share a key.
SHORT_KEYS, MORE = 10_000_000, 1.165
#: Class ids that are broadcast at most.
MAX_BROADCAST = 200_000


def _fingerprint(text: str | None, width: int) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and white space is x20 and x09 to x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    stops = ends[min(width, len(words)) - 1 :] - 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        a, b = starts[at : min(n, at + BLOCK)].tolist(), stops[at : min(n, at + BLOCK)].tolist()
        h = np.array([digest(joined[i:j], 42) for i, j in zip(a, b)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the SimHash of each text's word shingles, as a signed 64-bit number.

    A-Z become lower case; words are runs of other than ASCII white space; shingles of `width` words, repeats included, are joined by a space and hashed by XXH64
    (UTF-8, seed 42). A bit is 1 if it is set in over half the hashes. A text with fewer words is one shingle; null, empty and blank texts have fingerprint 0.
    Every row keeps its id, null and repeated ids too; other columns are left out.
    """

    def make():
        def fn(ids, texts):
            return [ids, [x - (1 << 64) if x >> 63 else x for x in (_fingerprint(t, width) for t in texts)]]

        return fn

    return map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment on the ring."""
    m = max_bits + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < BITS else fp


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): each pair of different fingerprints (column fp, distinct) that differ in at most max_bits bits, a < b; a pair may come more than once."""
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    ring = _segments(max_bits)
    m = len(ring)
    fp = F.col("fp")

    def key(i: int, flip: int | None = None) -> Column:
        (low, w), (low2, w2) = ring[i], ring[(i + 1) % m]
        second = _part(fp, low2, w2)
        return F.xxhash64(F.lit(i), _part(fp, low, w), second if flip is None else second.bitwiseXOR(F.lit(1 << flip).cast("long")))

    # The chain number stands in the hash and beside it: equal keys by chance only cost a check, as every pair is checked in full.
    index = fps.select(fp.alias("b"), F.explode(F.array(*(key(i) for i in range(m)))).alias("key"))
    probe = fps.select(fp.alias("a"), F.explode(F.array(*(key(i, f) for i in range(m) for f in (None, *range(ring[(i + 1) % m][1]))))).alias("key"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    parts = [F.bit_count(_part(diff, low, w)) for low, w in ring]
    chain = reduce(Column.__or__, (reduce(Column.__and__, (sum((parts[(i + j) % m] for j in range(n)), F.lit(0)) <= n - 1 for n in range(1, m + 1))) for i in range(m)))
    return probe.join(index.hint("shuffle_hash"), "key").filter((F.col("a") < F.col("b")) & chain & (F.bit_count(diff) <= max_bits)).select("a", "b")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, by alternating large-star and small-star rounds.

    Each round writes its edges to the shared checkpoint folder, so lineage stays short and a lost executor costs one round.
    """
    now = cut(edges.select("a", "b").distinct())
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a != b").distinct()
        new = cut(small)
        # Done when every edge is a star: no node is both a centre and a leaf, and no leaf has two centres.
        if new.select("b").join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and new.groupBy("b").count().filter("count > 1").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(df: DataFrame, width: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of df.

    fingerprint: 16 lowercase hex digits; component_id: the smallest id reachable over links of at most max_bits differing bits, the row's own included.
    Rows of null, empty or blank text have fingerprint zero and are linked as any other. A null id takes part in links, but is no component_id unless all ids of
    its component are null (then component_id is null). Repeated rows each return a row. Other columns, of whatever name, are left out.
    """
    rows = cut(fingerprints(df, width, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = connected(links(classes.select("fp"), max_bits))
    rooted = classes.join(star, classes.fp == star.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(component, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Word shingles as 64-bit hashes. A bounded memory of words spares hashing them again."""

    def __init__(self, most: int = 200_000):
        self.memo, self.most = {}, most

    def words(self, text: str | None) -> np.ndarray:
        import xxhash

        words, memo = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.memo
        if len(memo) > self.most:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def of(words: np.ndarray, width: int) -> np.ndarray:
        """The distinct shingles, sorted; fewer words than width make one."""
        if not len(words):
            return words
        width = min(width, len(words))
        n = len(words) - width + 1
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h = _mixed(h * np.uint64(_ODD) + words[j : j + n])
        return np.unique(h)


def _families(shingles: np.ndarray, count: int) -> list[int]:
    """SimHashes of a set of shingles under `count` hash functions, as signed numbers; without shingles all zero."""
    out = []
    for r in range(count):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(shingles), BLOCK):
            h = _mixed(shingles[at : at + BLOCK] + np.uint64((r + 1) * _ODD & (1 << 64) - 1))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0]))
    return out


def _class(words: np.ndarray) -> int:
    """A hash of the whole sequence of words, as a signed number; 0 without words."""
    c = 0
    for at in range(0, len(words), BLOCK):
        part = words[at : at + BLOCK]
        here = np.arange(at, at + len(part), dtype=np.uint64) * np.uint64(_ODD)
        c = (c * _ODD + int(np.bitwise_xor.reduce(_mixed(part + here)))) & ((1 << 64) - 1)
    return c - (1 << 64) if c >> 63 else c


def _keys(more: int) -> list[Column]:
    """A key for each segment of column f: the segment, and so many bits of the next on the ring."""
    ring = _segments(SEGMENTS - 1)
    out = []
    for i, (low, w) in enumerate(ring):
        after = _part(F.col("f"), ring[(i + 1) % SEGMENTS][0], more) if more else F.lit(0)
        out.append(F.xxhash64(F.lit(i), F.col("r"), _part(F.col("f"), low, w), after))
    return out


def _layout(texts: int) -> tuple[int, int]:
    """For so many texts: how many fingerprints each has, and how many bits of the next segment a key takes."""
    more = min(BITS // SEGMENTS - 8, max(0, ceil(log2(max(1, texts) / SHORT_KEYS))))
    return ceil(FAMILIES * MORE**more), more


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b, j) of classes with the Jaccard similarity of their sets of word shingles, if it is at least `similarity`. docs: (th, t), texts and their hashes;
    classes: (c, th), the hash of one text of each class."""
    pairs = as_table(pairs.distinct())
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    some = as_table(classes.join(broadcast_if_small(ids, MAX_BROADCAST), "c", "left_semi").select("c", "th"))
    found = docs.join(broadcast_if_small(some.select("th"), MAX_BROADCAST), "th", "left_semi").dropDuplicates(["th"])
    some = as_table(found.join(some, "th").select("c", "t"))
    both = pairs.join(some.select(F.col("c").alias("a"), F.col("t").alias("ta")), "a").join(some.select(F.col("c").alias("b"), F.col("t").alias("tb")), "b")

    def make():
        shingles = Shingles()

        def fn(a, b, ta, tb):
            known: dict[int, np.ndarray] = {}  # of one slice of rows
            keep, found = [], []
            for i, (x, y) in enumerate(zip(a, b)):
                for c, t in ((x, ta[i]), (y, tb[i])):
                    if c not in known:
                        known[c] = shingles.of(shingles.words(t), width)
                one, two = known[x], known[y]
                common = len(np.intersect1d(one, two, assume_unique=True))
                if common >= similarity * (len(one) + len(two) - common):
                    keep.append(i)
                    found.append(common / max(1, len(one) + len(two) - common))
            return [[a[i] for i in keep], [b[i] for i in keep], found]

        return fn

    return map_texts(both.select("a", "b", "ta", "tb"), make, "a long, b long, j double", rows=64)


def similar_texts(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, component_id, text_hash, root_id) of every row of df: texts whose sets of `width`-word shingles have a Jaccard similarity of at least `similarity` are linked.

    Texts of equal words (A-Z in lower case, ASCII white space between them) are one class, named by a hash. A class has FAMILIES fingerprints of its shingles. Candidates
    share a whole segment of one of them and then stay within the ring's budget of RING_BITS over CHECKED fingerprints from there on; each is compared in full by its
    shingles. Pairs that the filter misses are few (the README has the figures). component_id: the smallest id that is reachable over links, the row's own included.
    Null, empty and blank texts are one class. A null id is no component_id unless all ids of its component are null. Repeated rows each return a row; other columns
    are left out. text_hash: xxhash64 of the text. root_id: the class that names the component, never null, so components without an id or with the same one stay apart.

    No group is paired off in full. First each class meets the oldest class of the blocks of longer keys that hold it. The components of those links are then left
    alone: only classes of different components are compared. And as the Jaccard distance is a metric, two classes that were both compared with a third can be alike
    only if their distances from it differ by no more than theirs may.
    """

    families, more = _layout(df.count())
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))

    def make():
        shingles = Shingles()

        def fn(ids, hashes, texts):
            words = [shingles.words(t) for t in texts]
            sets = [shingles.of(w, width) for w in words]
            return [ids, hashes, [_class(w) for w in words], [len(x) for x in sets], [_families(x, families) for x in sets]]

        return fn

    rows = as_table(map_texts(docs, make, "doc_id long, th long, c long, n int, f array<long>"))
    classes = as_table(rows.groupBy("c").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.min("n").alias("n"), *(F.min(F.get("f", F.lit(r))).alias(f"f{r}") for r in range(families))))
    prints = classes.select("c", "n", F.array(*(f"f{r}" for r in range(families))).alias("f"))
    docs = docs.select("th", "t")

    def close(one: str, two: str) -> Column:
        """Numbers of shingles that allow the similarity."""
        return F.least(one, two) >= similarity * F.greatest(one, two)

    # Longer keys: a segment and half of the next. Few share one by chance, so a block's oldest class is mostly the origin of its copies.
    prints = prints.join(classes.select("c", F.coalesce("least", F.lit((1 << 63) - 1)).alias("least")), "c")
    long = prints.select("c", "n", "least", F.posexplode("f").alias("r", "f")).select("c", "n", "f", "least", F.explode(F.array(*_keys(more + 8))).alias("key"))
    heads = long.groupBy("key").agg(F.min(F.struct("least", "c", "n", "f")).alias("h"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    heads = broadcast_if_small(as_table(heads.select("key", F.col("h.c").alias("b"), F.col("h.n").alias("nb"), F.col("h.f").alias("fb"))), MAX_BROADCAST)
    within = F.bit_count(F.col("f").bitwiseXOR(F.col("fb"))) <= RING_BITS // CHECKED + 8
    star = long.join(heads, "key").filter((F.col("c") != F.col("b")) & within & close("n", "nb")).select(F.col("c").alias("a"), "b")
    met = as_table(_verified(star, docs, classes, width, 0.0))
    first = met.filter(F.col("j") >= similarity).select("a", "b")

    joined = connected(first)
    named = joined.union(joined.select(F.col("root").alias("node"), "root").distinct())
    # Of the heads that a class has met the one that most have met, and the distance from it; a head has met itself.
    fame = met.groupBy("b").agg(F.count(F.lit(1)).alias("fame"))
    far = met.unionByName(fame.select(F.col("b").alias("a"), "b", F.lit(1.0).alias("j"))).join(fame, "b").groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("h"), (1 - F.col("j")).alias("d")), F.struct("fame", "b")).alias("x"))
    far = far.select(F.col("a").alias("c2"), F.col("x.h").alias("h"), F.col("x.d").alias("d"))
    tagged = prints.join(named, F.col("c") == F.col("node"), "left").join(far, F.col("c") == F.col("c2"), "left").select("c", "n", "f", F.coalesce("root", "c").alias("g"), "h", "d")
    tagged = as_table(tagged)
    ring = [F.get("all", (F.col("r") + i) % families).alias(f"f{i}") for i in range(1, CHECKED)]
    short = tagged.select("c", "n", "g", "h", "d", F.col("f").alias("all"), F.posexplode("f").alias("r", "f")).select("c", "n", "g", "h", "d", F.col("f").alias("f0"), *ring, F.explode(F.array(*_keys(more))).alias("key"))
    a, b = short.alias("a"), short.hint("shuffle_hash").alias("b")
    bits = [F.bit_count(F.col(f"a.f{i}").bitwiseXOR(F.col(f"b.f{i}"))) for i in range(CHECKED)]
    chain = reduce(Column.__and__, (sum(bits[1 : i + 1], bits[0]) <= (i + 1) * RING_BITS // CHECKED + (4 if i + 1 < CHECKED else 0) for i in range(CHECKED)))
    may = F.coalesce((F.col("a.h") != F.col("b.h")) | (F.abs(F.col("a.d") - F.col("b.d")) <= 1 - similarity + 1e-9), F.lit(True))
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & (F.col("a.g") != F.col("b.g")) & close("a.n", "b.n") & may & chain)
    second = as_table(_verified(rest.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")), docs, classes, width, similarity)).select("a", "b")

    star = connected(first.union(second))
    rooted = classes.select("c", "least").join(star, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "least")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select("c", "component_id", "root")
    rows = rows.select("doc_id", "c", "th").join(named, "c")
    return rows.select("doc_id", F.lower(F.hex("c")).alias("class_id"), "component_id", F.col("th").alias("text_hash"), F.lower(F.hex("root")).alias("root_id"))
