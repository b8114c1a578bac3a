from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from tests.conftest import SF_DIR, rows_of
from tests.llm.odd import odd_docs
from vinlake.llm import filter_audit
from vinlake.llm.queries import ORACLE_SQL, QUERIES


def failures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
    return out | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def brute(docs, labels):
    """Every document through every order."""
    least = {}
    for d in docs:
        if d.doc_id is not None:
            least[d.text or ""] = min(d.doc_id, least.get(d.text or "", d.doc_id))
    marks = {}
    for r in labels:
        good, toxic = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = good or r.quality == 1, toxic or r.toxic == 1
    failed = [(d.source or "", failures(d.text) | ({"E"} if d.doc_id is not None and d.doc_id > least[d.text or ""] else set()), marks.get(d.doc_id, (False, False))) for d in docs]
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in permutations("ABCDE"):
            left = [(f, m) for p, f, m in failed if p == part]
            every = left
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for f, _ in every) - len(gone), sum(f == {x} for f, _ in every), sum(g for _, (g, _) in gone), sum(t for _, (_, t) in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_query_against_sql_and_brute_force(spark, duck):
    got, want = QUERIES["op12_filter_audit"](spark, SF_DIR), duck.sql(ORACLE_SQL["op12_filter_audit"])
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet").collect() for t in ("documents", "labels"))
    assert found(got) == brute(docs, labels)


def test_all_masks_meet(spark):
    """Texts that fail each mix of filters, copies of them in two parts, and an order that changes what a filter takes."""
    rows, texts = [], []
    for mask in range(16):
        words = ["abc"] * 9 if mask & 2 else [f"w{i}" for i in range(3)]
        words = words if mask & 1 else words + (["abc"] * 300 if mask & 2 else [f"v{i}" for i in range(300)])
        texts.append(" ".join(words) + ("X" * 200 if mask & 4 else "") + (" #" if mask & 8 else ""))
    for i, t in enumerate(texts * 3):
        rows.append((i, t, ("a", "b", None)[i % 3]))
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 48, 2)] + [(2, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = found(filter_audit.audit(docs, labels))
    assert got == brute(docs.collect(), labels.collect()) and len(got) == 1800
    assert {frozenset(failures(t)) for t in texts} > {frozenset(), frozenset("ABCD"), frozenset("D")}


def test_odd_rows(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1, 1, "x"), (11, 1, 0, "x"), (11, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    assert found(filter_audit.audit(df, labels)) == brute(df.collect(), labels.collect())
    assert filter_audit.audit(odd_docs(spark, 0), labels).count() == 0
    assert filter_audit.audit(df, labels.limit(0)).filter("good_lost > 0 or toxic_lost > 0").count() == 0
