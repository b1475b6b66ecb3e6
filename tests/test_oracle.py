"""Every registered query with an oracle must match DuckDB on the same
tables (sf0.001 here; the driver uses sf0.01)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = os.environ.get("FAIRGATE_TEST_SF", "/root/testdata/sf0.001")
SLOW = {"feature_importance_lineitem", "low_importance_lineitem",
        "governance_verdict_orders_forest"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    problems, _, _ = compare(spark, con, name, entry.queries()[name],
                             entry.oracle_sql()[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["column", "group", "count", "share", "outcome_rate", "warning"]
    assert df.count() > 0
