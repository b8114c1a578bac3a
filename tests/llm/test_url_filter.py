from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows_of
from vinlake.llm import url_filter
from vinlake.llm.queries import ORACLE_SQL, QUERIES


def test_query(spark, duck):
    got, want = QUERIES["op8_url_filter"](spark, SF_DIR), duck.sql(ORACLE_SQL["op8_url_filter"])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_cascade_is_exact_with_few_bits(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(keys)
    assert cascade.shards == 1 and len(cascade.levels[0]) > 4
    assert keys.filter(cascade.holds(F.col("key")) != F.col("listed")).isEmpty()


def test_cascade_of_the_query(spark, monkeypatch):
    """The query's own cascade has many levels; dealt out into shards it gives the same verdicts."""
    made = []
    start = url_filter.Cascade.__init__
    monkeypatch.setattr(url_filter.Cascade, "__init__", lambda self, *a: (start(self, *a), made.append(self))[0])
    sf = SF_DIR.replace("sf0.001", "sf0.1")
    one = QUERIES["op8_url_filter"](spark, sf).collect()
    many = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"), max_bytes=40).collect()
    assert len(made[0].levels[0]) >= 4 and made[1].shards > 2 and sorted(one) == sorted(many)
    assert 0 < sum(r.listed for r in one) < len(one) and {r.verdict for r in one if r.rule is None} == {"allow", "block"}


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "https://A.Example.NET/en/x?y"), (5, "http://example.net"), (6, "http://x.org/fr/a#b"), (7, "ftp://spam-farm.example.org?q"), (8, "http://deep.spam-farm.example.org/fr/"), (4, "https://A.Example.NET/en/x?y"), (None, "http://notexample.com/de/"), (9, "http://www.example.com/de/?"), (10, "://"), (11, "http://net/")]
    df = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (5, "example.net", "", None, "allow"), (6, "x.org", "/fr/a", "org/fr/", "allow"), (7, "spam-farm.example.org", "", None, "block"), (8, "deep.spam-farm.example.org", "/fr/", "org/fr/", "allow"), (9, "www.example.com", "/de/", "example.com/de/", "block"), (10, "", "", None, "allow"), (11, "net", "/", "net/", "block"), (None, "notexample.com", "/de/", None, "allow")]
    for most in (1 << 20, 8):  # in one piece, and dealt out
        got = url_filter.judge(df, max_bytes=most)
        assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == sorted(want, key=str)
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.filter("page_id = 7"), listed=[]).collect()} == {"allow"}
