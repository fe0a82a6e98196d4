"""Every registered query against its DuckDB oracle (driver-style compare)."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as E
from ratewise.queries import QUERIES
from tests.oracle_check import compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], sf_dir)
    assert r["cols"], (r["scols"], r["ocols"])
    assert r["rows"], (r["n_spark"], r["n_oracle"])
    assert r["values"], (r["sample_s"], r["sample_o"])


def test_library_stands_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without it imports and has all other queries."""
    root = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", "spark-warehouse")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"],
                         cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert out.stdout.split() == NAMES


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "rate_2000" in df.columns
