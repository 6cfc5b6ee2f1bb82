"""Every registered query against its DuckDB oracle (or rows-only), at the
smallest scale factor so the suite stays quick; tests/oracle_check.py runs
the same comparison at sf0.01."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

import __spark_entry__ as entry
from oracle_check import check

SF_SMALL = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"train_automl", "feature_importance", "leaderboard"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query_matches_oracle(spark, name):
    status, msg = check(spark, SF_SMALL, [name])[name]
    assert status in ("OK", "ROWS_ONLY"), msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "value" in df.columns
