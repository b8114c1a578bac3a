"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites that hold it; sketches merge by aggregation, in part before the shuffle. Lines whose estimate is clearly
above or below the limit are decided by it; lines near the limit get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, broadcast_if_small

#: Sites from which on a line is boilerplate.
SITES = 10
#: Sketches have 2^LG buckets, so a standard error of 1.04 / sqrt(2^LG); estimates within BAND of the limit, six standard errors, are counted exactly.
LG, BAND = 12, 0.1
#: Line hashes that are broadcast at most.
MAX_BROADCAST = 200_000


def _normal(line):
    """A-Z in lower case, white space at both ends gone and each run of it within one space."""
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def boilerplate(df: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Lines (k, th, pos, line) and boilerplate lines (line, first_k, first_th, first_pos): those that at least `sites` distinct sites hold, with the place that keeps them."""
    t = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(t).alias("th"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(t, "\n")).alias("pos", "l"))
    rows = rows.withColumn("l", _normal(F.col("l"))).filter("l != ''").select("k", "th", "site", "pos", F.xxhash64("l").alias("line"))
    rows = as_table(rows)  # texts are split and normalised once; four steps read these short rows
    # A line on `sites` sites stands in as many rows at least: a plain count, cheap to merge, spares sketches of lines that are found once.
    often = rows.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("line")
    often = broadcast_if_small(as_table(often), MAX_BROADCAST)
    some = rows.join(often, "line", "left_semi")
    by_line = some.groupBy("line").agg(F.hll_sketch_agg("site", LG).alias("sketch"), F.min(F.struct("k", "th", "pos")).alias("first"))
    spread = as_table(by_line.select("line", F.hll_sketch_estimate("sketch").alias("n"), "first"))
    near = spread.filter((F.col("n") > sites * (1 - BAND) - 1) & (F.col("n") < sites * (1 + BAND) + 1)).select("line")
    exact = some.join(broadcast_if_small(near, MAX_BROADCAST), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("exact"))
    found = spread.join(exact, "line", "left").filter(F.coalesce("exact", "n") >= sites)
    found = found.select("line", F.col("first.k").alias("first_k"), F.col("first.th").alias("first_th"), F.col("first.pos").alias("first_pos"))
    return rows, broadcast_if_small(as_table(found), MAX_BROADCAST)


def dedup_lines(df: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, then the columns named in carry: the text without cross-site boilerplate.

    Lines are what \\n separates; they are compared as normalised by _normal, and lines without a word never go. A line that at least `sites` distinct sites hold is
    removed wherever it stands, but for its first place (the smallest id, null first, then text hash, then position), so what whole copies repeat is not lost.
    Null sites count as no site. A null text stays null, with no lines; an empty one has one line. Rows that repeat an id and a text are treated alike.
    """
    names = [f"c{i}" for i in range(len(carry))]
    t = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(t).alias("th"), t.alias("t"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    rows, found = boilerplate(df, sites, id_col, text_col, site_col)
    first = F.col("k").eqNullSafe(F.col("first_k")) & F.col("th").eqNullSafe(F.col("first_th")) & (F.col("pos") == F.col("first_pos"))
    gone = rows.join(found, "line").filter(~first).groupBy("k", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = gone.select(F.col("k").alias("k2"), F.col("th").alias("th2"), "gone")
    out = docs.join(gone, (F.col("th") == F.col("th2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
    parts = F.split("t", "\n")
    # What stays are the runs of lines between removed ones: each line is copied once, however many there are.
    at = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size(parts)))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice(parts, F.get(at, i) + 2, F.get(at, i + 1) - F.get(at, i) - 1))
    left = F.array_join(F.flatten(runs), "\n")
    return out.select(
        F.col("k").alias("doc_id"), F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias("text"),
        F.when(F.col("t").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), *(F.col(n).alias(c) for c, n in zip(carry, names)),
    )


#: The same by DuckDB. Exact distinct counts: sketches only decide what is far from the limit.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), n AS (
  SELECT doc_id, source, pos, line AS raw, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l
), b AS (
  SELECT line, min(struct_pack(k := doc_id, p := pos)) AS f FROM n WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), g AS (
  SELECT n.doc_id, n.pos, n.raw, b.line IS NOT NULL AND NOT (b.f.k = n.doc_id AND b.f.p = n.pos) AS gone FROM n LEFT JOIN b ON n.line = b.line
), j AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM g GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN j USING (doc_id)
"""
