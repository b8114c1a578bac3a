"""Each query against its DuckDB twin, rows without order."""

from __future__ import annotations

import pytest

from tests.conftest import SF_DIR, duck_over, rows_of
from vinlake.plans import ORACLE_SQL, QUERIES


def same_rows(spark, duck, name, sf_dir) -> int:
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b
    return len(a)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    if not same_rows(spark, duck, name, SF_DIR):  # a comparison of nothing says nothing
        larger = SF_DIR.replace("sf0.001", "sf0.01")
        assert same_rows(spark, duck_over(larger), name, larger) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
