"""Operators that SQL can express against their reference SQL."""

import pytest
from busweave.llm.registry import ORACLE_SQL, QUERIES
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    _, problem, _ = compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLE_SQL[name])
    assert problem is None


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES
