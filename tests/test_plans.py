"""Physical plans: what reaches the scan, and what must not be in any plan."""

from __future__ import annotations

import re

import pytest

from tests.conftest import SF_DIR
from vinlake.plans import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)
    if name != "mileage_salvage":
        assert "ArrowEvalPython" not in text


def scans(text: str, table: str) -> list[str]:
    return [line for line in text.split("\n") if "FileScan" in line and f"{table}.parquet" in line]


def test_columns_and_filters_reach_the_scan(spark):
    batch = scans(plan(QUERIES["keyset_batch"](spark, SF_DIR)), "orders")[0]
    assert "GreaterThan(o_orderkey,5000)" in batch and "o_totalprice" not in batch.split("ReadSchema")[1]
    found = scans(plan(QUERIES["ingest_gates"](spark, SF_DIR)), "lineitem")
    assert found and all("l_shipdate" not in x.split("ReadSchema")[1] for x in found)
    usage = scans(plan(QUERIES["usage_series_daily"](spark, SF_DIR)), "events")[0]
    assert "GreaterThanOrEqual(ts" in usage and "user_id" not in usage.split("ReadSchema")[1]


def test_one_shuffle_for_windows_of_one_client(spark):
    assert plan(QUERIES["rate_limits"](spark, SF_DIR)).count("Exchange hashpartitioning(client_id") <= 2
