from __future__ import annotations

from tests.conftest import SF_DIR, rows_of
from tests.llm.odd import odd_docs
from vinlake.llm import line_dedup
from vinlake.llm.queries import ORACLE_SQL, QUERIES


def test_query(spark, duck):
    got, want = QUERIES["op3_line_dedup"](spark, SF_DIR), duck.sql(ORACLE_SQL["op3_line_dedup"])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_spread_first_place_and_odd_rows(spark):
    rows = [(i, f"Only {i}\n  FOLLOW   us \nend{i}", f"s{i % 4}") for i in range(8)] + [(90, "follow us", None), (91, None, "s1"), (92, "", "s1"), (93, "rare\nrare", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, sites=4).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == f"Only {i}\nend{i}" and got[i].n_removed == 1 for i in range(1, 8))
    assert got[90].text == "" and got[91].text is None and got[91].n_lines == 0 and got[92].text == "" and got[92].n_lines == 1 and got[93].text == "rare\nrare"
    assert {r.text for r in line_dedup.dedup_lines(df, sites=5).collect()} == {r[1] for r in rows}
    odd = line_dedup.dedup_lines(odd_docs(spark), sites=2, carry=("lang", "line"))
    assert odd.count() == odd_docs(spark).count() and odd.columns[-2:] == ["lang", "line"]
    assert line_dedup.dedup_lines(odd_docs(spark, 0)).count() == 0
