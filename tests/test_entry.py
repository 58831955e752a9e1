"""The driver's contract: every query runs on the smallest tables, and SQL agrees where there is any."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

from statuta import plans

CORE, SQL = plans.collect()


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return round(float(v), 5) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def connection(small):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, small, connection, name):
    df = CORE[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        result = connection.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert got == want


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "statuta.llm", None)
    monkeypatch.delitem(sys.modules, "statuta.llm.plans", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    module = importlib.import_module("__spark_entry__")
    assert set(module.queries()) == set(CORE)
    sys.modules.pop("__spark_entry__", None)
