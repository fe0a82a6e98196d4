"""Queries against their DuckDB SQL."""

from __future__ import annotations

import pytest

from ratewise.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    r = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLE_SQL[name], sf_dir)
    assert r["cols"] and r["rows"] and r["values"], r
