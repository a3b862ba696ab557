"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from busweave.workload import oracle as SQL, queries, timed
from oracle import compare, connect

QUERIES = {**queries.QUERIES, **timed.QUERIES}
ORACLE_SQL = {**SQL.ORACLE_SQL, **timed.ORACLE_SQL}

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_own_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    _, problem, _ = compare(spark, db, SF_DIR, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and "match_value" in frame.columns


@pytest.mark.parametrize("name", [
    "extract_messages", "filter_time_window", "window_with_continuations", "match_messages",
    "decode_join", "change_points", "step_intervals", "asof_signal_value", "accuracy_report",
    "accuracy_mismatch_detail", "batch_by_length", "fill_message_rows", "quota_sample",
    "build_signal_dictionary", "reply_counts", "analyze_properties", "signal_sessions", "signal_silences",
    "steps_by_session", "held_together", "assign_years", "window_over_new_year", "accuracy_rollup",
    "payload_size_rollup", "indexed_name_search", "reconcile_messages", "decode_multiplexed",
])
def test_plans_have_no_products_or_python(spark, name):
    plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_time_filters_reach_the_line_table(spark):
    plan = contract.queries()["window_with_continuations"](spark, SF_DIR)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text


def test_message_window_reads_its_days_only(spark):
    frame = contract.queries()["message_window"](spark, SF_DIR)
    text = frame._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters"):]
    assert "day" in filters.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(time" in filters
