"""Filter interaction audit: what each of five filters removes in each order of all five.

A text's failures are five bits, built by native expressions; a groupBy over texts supplies the smallest doc_id of each, for the filter of repeated texts. Whatever the
order, what a filter sees depends only on the mask, so documents are counted once into 32 cells a part, and the 120 orders are enumerated from the cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import as_table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"
_SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """The bits of filters A to D of a text (A is bit 0): under 200 words, under 50 % distinct words, over 2 % capitals A-Z, a symbol. Null is as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, _SPACE), "")
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(t),
        t.rlike(f"[{SYMBOLS}]"),
    )
    return reduce(Column.bitwiseOR, (F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)))


def masks(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row of df; good and toxic: 1 if labels (doc_id, quality, toxic) say so, else 0.

    Texts are equal if their SHA-256 digests are, so that 32 bytes of each move and not the text. Bit E: a smaller id has the same text. The row of a text's smallest id
    is found by a join on digest and id, which spreads a text that a third of all rows repeat.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = as_table(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(F.col(text_col)).alias("bits")))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("least", F.lit(True))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    found = rows.join(least, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    repeats = F.when(F.col("least").isNull() & F.col("doc_id").isNotNull(), 1 << 4).otherwise(0)
    zero = F.lit(0)
    return found.select("doc_id", "part", F.col("bits").bitwiseOR(repeats).alias("mask"), F.coalesce("quality", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits before the step, the number of the step's filter) of all 600 steps."""
    return [("".join(p), k + 1, sum(1 << FILTERS.index(x) for x in p[:k]), FILTERS.index(p[k])) for p in permutations(FILTERS) for k in range(5)]


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part of df, zeros included.

    kept: documents that remain after the step; removed: that the step takes; redundant: that fail its filter but went before; unique_fails: that fail it alone;
    good_lost, toxic_lost: removed ones labelled so; shapley: what the filter removes, summed over all orders.

    A null part is the empty string, a null text the empty text. A row without id is counted, has no label and is no repeat of another; rows that repeat an id and a text
    count each and are no repeats of one another. Labels without a row, or null, say nothing; of several for an id any 1 counts. Without rows there is no part and no row.
    Other columns are left out.
    """
    one = lambda c: F.sum(c).cast("long").alias(c)
    cells = masks(df, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most

    def over(keep, what: str, per=lambda m: F.lit(1)) -> Column:
        """The sum over the cells that keep(mask) takes, each times per(mask)."""
        return F.aggregate(F.filter("cells", lambda c: keep(c["mask"])), F.lit(0).cast("long"), lambda s, c: s + c[what] * per(c["mask"]))

    # passed[b]: documents that fail none of the filters of b, so those that are there after these, in whatever order.
    passing = lambda what: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: over(lambda m: m.bitwiseAND(b) == 0, what)).alias(f"{what}_passed")
    # Each of the filters that a document fails comes first of them in equally many of the orders, so each removes it in 120 / (their number) of them.
    share = lambda m: (120 / F.bit_count(m)).cast("long")
    fair = F.transform(F.array(*(F.lit(1 << i) for i in range(5))), lambda b: over(lambda m: m.bitwiseAND(b) != 0, "n", share)).alias("fair")
    steps = F.split(F.lit(",".join(f"{o} {k} {before} {i}" for o, k, before, i in orders())), ",")  # one literal, not thousands of them
    flat = parts.select("part", passing("n"), passing("good"), passing("toxic"), fair).select("*", F.explode(steps).alias("s")).withColumn("s", F.split("s", " "))
    flat = flat.withColumns({"filter_order": F.col("s")[0]} | {c: F.col("s")[k].cast("int") for k, c in enumerate(("step", "before", "i"), 1)}).withColumn("bit", F.expr("shiftleft(1, i)"))
    after = F.col("before").bitwiseOR(F.col("bit"))
    gone = lambda w: F.get(f"{w}_passed", F.col("before")) - F.get(f"{w}_passed", after)
    passes = lambda bits: F.get("n_passed", bits)
    return flat.select(
        "part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), passes(after).alias("kept"), gone("n").alias("removed"),
        (passes(F.lit(0)) - passes(F.col("bit")) - gone("n")).alias("redundant"), (passes(31 - F.col("bit")) - passes(F.lit(31))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("fair", F.col("i")).alias("shapley"),
    )


#: Every document through every order, one step after the other.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT d.doc_id, part, len(w) < {LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) AS c,
    regexp_matches(text, '[{SYMBOLS}]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), g AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f
), walk AS (
  SELECT part, good, toxic, failed, filter_order, CASE WHEN failed = '' THEN 6 ELSE strpos(filter_order, substring(regexp_replace(filter_order, '[^' || failed || ']', '', 'g'), 1, 1)) END AS gone_at FROM g, o
), steps AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, substring(filter_order, step, 1) AS filter, CAST(count(*) FILTER (gone_at > step) AS BIGINT) AS kept, CAST(count(*) FILTER (gone_at = step) AS BIGINT) AS removed,
    CAST(count(*) FILTER (gone_at < step AND contains(failed, substring(filter_order, step, 1))) AS BIGINT) AS redundant, CAST(count(*) FILTER (failed = substring(filter_order, step, 1)) AS BIGINT) AS unique_fails,
    CAST(count(*) FILTER (gone_at = step AND good) AS BIGINT) AS good_lost, CAST(count(*) FILTER (gone_at = step AND toxic) AS BIGINT) AS toxic_lost
  FROM walk, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM steps
"""
