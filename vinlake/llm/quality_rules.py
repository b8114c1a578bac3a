"""Quality rules with cross-document line frequency.

Base rules look at one text. The method then hashes normalised lines and counts, for each host, the distinct documents that hold a line. Lines above the limit are
removed, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, broadcast_if_small, map_texts

#: A line of a host is boilerplate if more documents of the host than LIMIT hold it, however large the host is.
LIMIT = 3
#: A document is depleted if less than this share of its words is in lines that stay.
LEAST_LEFT = 0.5
#: Rows (of a host and a hash) that are broadcast at most.
MAX_BROADCAST = 100_000
_SYMBOLS = "#*$%&|<>"


def _base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dups += line in seen
            seen.add(line)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        until = 0  # words up to here are counted or can't be
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), symbols, dups, repeated


def base_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("t"))

    def make():
        def fn(ids, hosts, hashes, texts):
            return [ids, hosts, hashes, *(list(x) for x in zip(*map(_base, texts)))]

        return fn

    out = map_texts(rows, make, "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, host, pos, line, words): every line with a word, as a hash of its normalised form, with its number of words.

    Normalised: white space at both ends gone, each run of it within one space, A-Z in lower case."""
    t = F.col(text_col).cast("string")
    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.col(host_col).cast("string").alias("host"), F.posexplode(F.split(t, "\n")).alias("pos", "l"))
    plain = F.translate(F.trim(F.regexp_replace("l", r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = one.withColumn("l", plain).filter("l != ''")
    return one.select("doc_id", "text_hash", "host", "pos", F.xxhash64("l").alias("line"), (F.length("l") - F.length(F.translate("l", " ", "")) + 1).alias("words"))


def rule_quality(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, least_left: float = LEAST_LEFT
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_cut_words, kept) of every row.

    Words are runs of other than ASCII white space. n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words inside 3-word windows that are
    found twice or more. base_failed: under 50 words, or over half of them repeated. n_cut_words: words in lines that more than `limit` distinct documents of the
    host hold. kept: not base_failed, and at least least_left of the words are in other lines.

    A null or empty text has no words and fails. Rows with a null host form a host of their own; a null id counts as no document; rows that repeat an id, text and
    host get the same result, each as a row. Other columns are left out.
    """
    base = base_rules(df, id_col, text_col, host_col)
    all_lines = lines(df, id_col, text_col, host_col)
    # One row for each document and line, and then the documents of each host and line: each step sums within tasks before its shuffle.
    held = all_lines.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one")).filter("doc_id is not null")
    often = held.groupBy("host", "line").agg(F.count("one").alias("n_docs")).filter(F.col("n_docs") > limit)
    often = broadcast_if_small(as_table(often.select(F.col("host").alias("h2"), F.col("line").alias("l2"))), MAX_BROADCAST)
    # Where these are too many to broadcast, the rows of a hot line meet in one partition, which adaptive execution splits.
    cut = all_lines.join(often, F.col("host").eqNullSafe(F.col("h2")) & (F.col("line") == F.col("l2")), "left_semi")
    cut = cut.groupBy("doc_id", "text_hash", "host", "pos").agg(F.max("words").alias("words"))  # repeated rows count once
    per_doc = cut.groupBy("doc_id", "text_hash", "host").agg(F.sum("words").cast("long").alias("n_cut"))
    per_doc = per_doc.select(F.col("doc_id").alias("d2"), F.col("text_hash").alias("t2"), F.col("host").alias("h2"), "n_cut")
    out = base.join(per_doc, (F.col("text_hash") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("host").eqNullSafe(F.col("h2")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", n_cut.alias("n_cut_words"),
        (~F.col("base_failed") & (F.col("n_words") - n_cut >= least_left * F.col("n_words"))).alias("kept"),
    )


def oracle_sql() -> str:
    """The same by DuckDB, over whole lines and words instead of their hashes."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM d
), n AS (
  SELECT doc_id, source, raw, translate(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), often AS (
  SELECT source, line FROM n GROUP BY ALL HAVING count(DISTINCT doc_id) > {LIMIT}
), cut AS (
  SELECT n.doc_id, sum(len(string_split(n.line, ' '))) AS n_cut FROM n JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.line = o.line GROUP BY n.doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup FROM n GROUP BY doc_id
), win AS (
  SELECT doc_id, i, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_rep FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_cut_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_cut_words >= {LEAST_LEFT} * n_words AS kept
FROM f
"""


ORACLE_SQL = oracle_sql()
