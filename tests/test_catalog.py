"""Every registered query against its SQL at the smallest scale."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

SF, NEXT_SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    problems, rows, _ = check.compare(df, duck, entry.oracle_sql()[name])
    assert not problems
    if not rows:  # the smallest tables may hold none of the rows asked for, the next ones must
        assert not entry.queries()[name](spark, NEXT_SF).isEmpty()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1


def test_files_after_lines_grow_in_number_not_in_size(spark, monkeypatch):
    from skyweave import session
    from skyweave.catalog import QUERIES

    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    got = QUERIES["s03_csv_after_lines"](spark, "/root/testdata/sf0.001")
    lines = [spark.read.text(f).count() for f in got.inputFiles() if f.endswith(".txt")]
    assert len(lines) > 6 and max(lines) < 1500
    assert got.count() == sum(lines) - 3 * len(lines) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
