"""One session for all tests, and a comparison of Spark's rows with DuckDB's."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from vinlake.session import session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    return duck_over(SF_DIR)


def duck_over(sf_dir):
    import duckdb

    d = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return d


def plain(v):
    """A value in a form that both engines share."""
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if type(v).__name__ == "Decimal":
        return plain(float(v)) if v != int(v) else int(v)
    if type(v).__name__ == "date":
        return str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
