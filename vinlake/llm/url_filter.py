"""URL filters: rules by host and path, and a Bloom filter cascade for listed domains and pages.

The cascade gives exact membership over a complete key universe without a join. Level 1 is a Bloom filter of the listed keys; level 2 one of level 1's false
positives among all other keys of the corpus; level 3 one of the listed keys that level 2 holds by mistake; and so on until a level has no false positive. A key is
listed if the first level that doesn't hold it is an even one (counting from 1).

Everything here is DataFrame functions; the driver holds only the levels' bits, some log2(universe / listed) * 1.44 + 4 of them a listed key. They go out as binary
literals of bounded size: a larger cascade is dealt out by a hash of the keys into several, each for its own part of the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.llm.common import as_table

#: Host and all its subdomains, path prefix, verdict. The longest that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Domains that are blocked with all their subdomains where no rule fits.
LISTED = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org", "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org", "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)
#: Pages that are blocked: for each number, language and ending that page addresses of the corpus have, so that the list has a realistic size. No public list is at hand.
LISTED_PAGES, LISTED_ENDINGS, LISTED_STEP, LISTED_TO = ("example.com", "example.net", "example.org"), ("", "/", ".html"), 37, 250_000
LANGUAGES = ("en", "de", "fr", "es")
#: Bits of a cascade that are sent to the executors in one piece.
MAX_BYTES = 8 << 20


def listed_keys(spark: SparkSession) -> DataFrame:
    """(key): LISTED, and domain, slash, language, slash, number and ending of each listed page."""
    each = [F.explode(F.array(*map(F.lit, x))) for x in (LISTED_PAGES, LANGUAGES, LISTED_ENDINGS)]
    pages = spark.range(0, LISTED_TO, LISTED_STEP).select("id", each[0].alias("d")).select("*", each[1].alias("l")).select("*", each[2].alias("e"))
    return spark.createDataFrame([(x,) for x in LISTED], "key string").union(pages.select(F.concat("d", F.lit("/"), "l", F.lit("/"), F.col("id").cast("string"), "e").alias("key")))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty if the url is null or has no ://."""
    host = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if the url is null or has no ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def parents(host: Column) -> Column:
    """The host and each domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def keys_of(host: Column, path: Column) -> Column:
    """What a list may hold of an address: the host and each domain above it, alone and with the path."""
    return F.array_distinct(F.flatten(F.transform(parents(host), lambda d: F.array(d, F.concat(d, path)))))


class Level:
    """A Bloom filter. Its bits go to the executors as one binary literal."""

    def __init__(self, number: int, n: int, rate: float):
        self.number = number
        self.bits = 64 * max(1, ceil(max(n, 1) * log(1 / rate) / log(2) ** 2 / 64))
        self.hashes = max(1, round(self.bits / max(n, 1) * log(2))) if n else 1
        self.hashes = min(self.hashes, 24)
        self.raw = bytearray(self.bits // 8)

    def places(self, key: Column) -> list[Column]:
        one, two = F.xxhash64(F.lit(2 * self.number), key), F.xxhash64(F.lit(2 * self.number + 1), key)
        return [F.pmod(F.pmod(one, F.lit(self.bits)) + F.lit(j) * F.pmod(two, F.lit(self.bits)), F.lit(self.bits)) for j in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """Bits are or-ed by word in Spark; at most self.bits / 64 rows come back, a million of them for the largest cascade."""
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("p"))
        words = at.groupBy((F.shiftright("p", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        for w, b in words.collect():
            self.raw[8 * w : 8 * w + 8] = b.to_bytes(8, "little", signed=True)
        return self

    def holds(self, key: Column) -> Column:
        raw, out = F.lit(bytes(self.raw)), F.lit(True)
        for p in self.places(key):
            byte = F.conv(F.hex(F.substring(raw, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.call_function("shiftright", byte, p.bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class Cascade:
    """Exact membership of listed keys in a key universe. keys: DataFrame(key, listed boolean), each key once."""

    def __init__(self, keys: DataFrame, max_bytes: int = MAX_BYTES):
        keys = as_table(keys)
        n = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
        yes, no = n.get(True, 0), n.get(False, 0)
        self.shards = max(1, ceil(yes * (1.44 * log2(2 + no / max(1, yes)) + 4) / 8 / max_bytes))
        self.levels = [self._levels(keys.filter(self._shard(F.col("key")) == s) if self.shards > 1 else keys) for s in range(self.shards)]

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards))

    @staticmethod
    def _levels(keys: DataFrame) -> list[Level]:
        inside, outside = keys.filter("listed").select("key"), keys.filter("not listed").select("key")
        n_in, n_out = inside.count(), outside.count()
        levels: list[Level] = []
        while n_in:
            # The usual rates: the first level takes what makes the cascade smallest, later ones one half.
            rate = min(0.5, max(1e-6, n_in / max(1, n_out) / log2(4))) if not levels else 0.5
            levels.append(Level(len(levels), n_in, rate).fill(inside))
            wrong = as_table(outside.filter(levels[-1].holds(F.col("key"))))
            inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
        return levels

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        found = F.lit(False)
        for s, levels in enumerate(self.levels):
            out = F.lit(False)
            for i in reversed(range(len(levels))):
                out = levels[i].holds(key) & ((~out) if i + 1 < len(levels) else F.lit(True))
            found = F.when(self._shard(key) == s, out).otherwise(found) if self.shards > 1 else out
        return found


def judge(df: DataFrame, listed: DataFrame | Sequence[str] | None = None, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row.

    listed: domains, or domains with a whole path (a sequence, or a DataFrame whose first column holds them; listed_keys if not given), blocked with their subdomains
    where no rule fits; nulls and repeats in it don't count. rule: the longest rule that fits (host and path together), else null. verdict: allow or block, the rule's,
    else block if a key of the address is listed. A null url, or one without ://, has empty host and path, fits no rule and is allowed unless the empty host is listed.
    Repeated rows each return a row.
    """
    spark: SparkSession = df.sparkSession
    if listed is None:
        listed = listed_keys(spark)
    elif not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in listed], "key string")
    listed = listed.select(F.col(listed.columns[0]).cast("string").alias("key")).filter("key is not null").distinct()
    url = F.col(url_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"))
    # The complete key universe: every key of an address of the corpus.
    universe = rows.select("host", "path").distinct().select(F.explode(keys_of(F.col("host"), F.col("path"))).alias("key")).distinct()
    cascade = Cascade(universe.join(listed.withColumn("yes", F.lit(True)), "key", "left").select("key", F.col("yes").isNotNull().alias("listed")), max_bytes)
    rows = rows.withColumn("listed", F.exists(keys_of(F.col("host"), F.col("path")), cascade.holds))
    rule = F.lit(None).cast("string")
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later, longer ones stand outside and win
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def oracle_sql() -> str:
    """The same by DuckDB: the list as a set of keys, which an address has or not."""
    values = lambda x: ", ".join(f"('{v}')" for v in x)
    fits = [
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), listed AS (
  SELECT key FROM (VALUES {values(LISTED)}) AS v(key)
  UNION ALL SELECT d || '/' || l || '/' || n || e FROM range(0, {LISTED_TO}, {LISTED_STEP}) AS r(n), (VALUES {values(LISTED_PAGES)}) AS d(d), (VALUES {values(LANGUAGES)}) AS l(l), (VALUES {values(LISTED_ENDINGS)}) AS e(e)
), k AS (
  SELECT host, path, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS d FROM (SELECT DISTINCT host, path FROM h)
), bad AS (
  SELECT DISTINCT host, path FROM k WHERE d IN (SELECT key FROM listed) OR d || path IN (SELECT key FROM listed)
), r AS (
  SELECT h.*, CASE {" ".join(fits)} END AS rule, EXISTS (SELECT 1 FROM bad b WHERE b.host = h.host AND b.path = h.path) AS listed FROM h
)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


ORACLE_SQL = oracle_sql()
