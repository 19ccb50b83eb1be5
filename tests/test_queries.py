"""Every query of the library proper against its SQL on the smallest tables."""

from __future__ import annotations

import importlib
import subprocess
import sys

import pytest

from quarrylake import registry
from tests.conftest import ROOT, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, small_dir, duck, name):
    frame = registry.QUERIES[name](spark, small_dir)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, small_dir, name):
    assert registry.QUERIES[name](spark, small_dir).collect() is not None


def test_every_oracle_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


def test_the_library_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['quarrylake.llm'] = None; import __spark_entry__ as e; assert e._llm is None; assert e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
