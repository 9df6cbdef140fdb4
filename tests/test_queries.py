"""Registered queries against their SQL.

A selection runs by default; MATCHBOOK_ALL=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
FAST = ["open_set_search", "k1_stable_top10", "a2_map_at_10", "a6_refusal_curve", "p13_cell_groups", "s10_candidate_table", "f13_policy_chain", "t5_operation_log_summary", "u5_sql_functions"]
NAMES = list(entry.queries()) if os.environ.get("MATCHBOOK_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    text, _, ok = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, text


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
