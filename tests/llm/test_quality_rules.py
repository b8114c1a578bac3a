from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows_of
from tests.llm.odd import odd_docs
from vinlake.llm import quality_rules
from vinlake.llm.queries import ORACLE_SQL, QUERIES


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dups = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(marked)


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def brute(docs, limit, least_left):
    """n_cut_words and kept of each document, from all its lines."""
    held = {}
    for d in docs:
        for x in (d.text or "").split("\n"):
            held.setdefault((d.source, b" ".join(x.encode().lower().split())), set()).add(d.doc_id)
    out = {}
    for d in docs:
        n, *_, repeated = base(d.text)
        lines = [b" ".join(x.encode().lower().split()) for x in (d.text or "").split("\n")]
        cut = sum(len(x.split()) for x in lines if len(held[d.source, x]) > limit)
        out[d.doc_id] = cut, n >= 50 and 100 * repeated <= 50 * n and n - cut >= least_left * n
    return out


def test_verdict_against_brute_force(spark, duck):
    """The method's own verdict, on tables where it cuts lines and rejects documents: at sf0.1 the copies that a host holds many of."""
    got, want = QUERIES["op10_quality_rules"](spark, SF_DIR), duck.sql(ORACLE_SQL["op10_quality_rules"])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    for sf, cut, rejected in (("sf0.01", 100, 0), ("sf0.1", 3000, 10)):
        at = SF_DIR.replace("sf0.001", sf)
        docs = spark.read.parquet(f"{at}/documents.parquet").collect()
        got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, at).collect()}
        assert {i: (r.n_cut_words, r.kept) for i, r in got.items()} == brute(docs, quality_rules.LIMIT, quality_rules.LEAST_LEFT)
        assert sum(r.n_cut_words > 0 for r in got.values()) > cut and sum(not r.kept and not r.base_failed for r in got.values()) >= rejected


def test_frequent_lines_and_odd_rows(spark):
    line, own = "menu of this site " * 10, "words of its own " * 1
    rows = [(i, line + "\n" + " ".join(f"w{i}_{j}" for j in range(20)), "a") for i in range(60)] + [(100 + i, line + "\n" + " ".join(f"w{i}_{j}" for j in range(60)), None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality_rules.rule_quality(df, limit=50)
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i].n_cut_words == 40 for i in range(60)) and all(got[100 + i].n_cut_words == 0 for i in range(5)) and own
    odd = quality_rules.rule_quality(odd_docs(spark))
    assert odd.count() == odd_docs(spark).count() and all(r.base_failed for r in odd.collect() if r.n_words == 0)
    assert quality_rules.rule_quality(odd_docs(spark, 0)).count() == 0


def test_the_limit_does_not_grow_with_the_host(spark):
    line = "menu of this site " * 10
    text = F.when(F.col("doc_id") < 51, F.concat(F.lit(line + "\n"), F.col("doc_id").cast("string"))).when(F.col("doc_id") < 101, F.concat(F.lit("rarer " + line + "\n"), F.col("doc_id").cast("string")))
    df = spark.range(60_000).select(F.col("id").alias("doc_id")).select("doc_id", F.coalesce(text, F.concat(F.lit("w"), "doc_id")).alias("text"), F.lit("a").alias("source"))
    got = {r.doc_id: r.n_cut_words for r in quality_rules.rule_quality(df, limit=50).filter("n_cut_words > 0 or doc_id < 101").collect()}
    assert got == {i: 40 if i < 51 else 0 for i in range(101)}
