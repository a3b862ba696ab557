"""Rollups, multiset comparison and the name index."""

import random
from collections import Counter

import pytest
from busweave.operators import dictionary, names, reconcile, rollups


def test_reconcile_counts_surplus_on_either_side(spark):
    rng = random.Random(4)
    draw = lambda n: [(rng.choice(["a", None, "c"]), rng.choice([1, 2, None]), rng.choice(["p", "q"])) for _ in range(n)]
    left, right = draw(300) + [("hot", 1, "p")] * 500, draw(280) + [("hot", 1, "p")] * 499
    schema = "time string, service_id bigint, payload string"
    got = reconcile.reconcile(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).select("payload", "time", "service_id"))
    a, b = Counter(left), Counter(right)
    want = {(*r, "left" if a[r] > b[r] else "right", abs(a[r] - b[r]), a[r], b[r]) for r in a | b if a[r] != b[r]}
    assert {tuple(r) for r in got.collect()} == want
    counts = reconcile.reconciliation_counts(got).first()
    assert counts["left_surplus"] == sum((a - b).values()) and counts["right_distinct"] == len(b - a)
    same = reconcile.reconcile(spark.createDataFrame(left, schema), spark.createDataFrame(left, schema))
    assert same.count() == 0 and tuple(reconcile.reconciliation_counts(same).first()) == (0, 0, 0, 0)


def test_reconcile_is_one_shuffle(spark):
    table = spark.createDataFrame([(1, "a")], "n bigint, s string")
    plan = reconcile.reconcile(table, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rollup_is_one_scan_and_one_shuffle(spark, tmp_path):
    rows = [("rx", 1, 2, "01 02"), ("rx", 1, 3, ""), ("tx", None, 3, "01"), ("rx", 1, 2, "01 02 03")]
    spark.createDataFrame(rows, "type string, service_id bigint, method_id bigint, payload string").write.parquet(f"{tmp_path}/m")
    got = rollups.payload_size_rollup(spark.read.parquet(f"{tmp_path}/m"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1 and plan.count("Expand") >= 1
    found = {(r["type"], r["service_id"], r["method_id"], r["level_of"]): (r["messages"], r["bytes"], r["least_bytes"], r["most_bytes"]) for r in got.collect()}
    assert found[None, None, None, 7] == (4, 6, 0, 3)
    assert found["tx", None, None, 1] == (1, 1, 1, 1) and found["tx", None, None, 3] == (1, 1, 1, 1)
    assert found["rx", 1, 2, 0] == (2, 5, 2, 3) and found["rx", 1, None, 1] == (3, 5, 0, 3)


def test_accuracy_rollup(spark):
    rows = [("a", 1, 2, "rx", "exact"), ("a", 1, 2, "rx", "missing"), ("b", 1, 3, "tx", "exact")]
    got = rollups.accuracy_rollup(spark.createDataFrame(rows, "log string, service_id bigint, method_id bigint, type string, level string"))
    by = {tuple(r)[:5]: r for r in got.collect()}
    total = next(r for r in by.values() if r["level_of"] == 15)
    assert (total["truth_rows"], total["exact_rows"], total["missing_rows"]) == (3, 2, 1)
    assert any(r["log"] == "a" and r["service_id"] is None and r["accuracy"] == 50.0 for r in by.values())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    listed = [(i, "__".join(rng.choice(["Speed", "speedX", "Mode", "ÄÖ", "a"]) + str(rng.randrange(30)) for _ in range(2))) for i in range(800)]
    listed += [(800, ""), (801, "Speed"), (802, None), (803, "é" * 5000)]
    table = spark.createDataFrame(listed, "line_key bigint, name string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    names.write_name_index(table, path)
    return table, path


@pytest.mark.parametrize("query", ["speed", "SPEEDx1", "e", "__", "äö", "0__m", "nothing", "  ", " mode ", "éé", "speed1__speed", "1__a2"])
def test_index_finds_what_a_scan_finds(spark, index, query):
    table, path = index
    want = [tuple(r) for r in dictionary.search_signal_names(table, query, 100).select("line_key", "name").collect()]
    got = [tuple(r) for r in names.indexed_search(spark, path, query, 100).select("line_key", "name").collect()]
    assert got == want


def test_search_reads_only_its_runs(spark, index):
    plan = names.indexed_search(spark, index[1], "speedx", 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(run" in plan and "TakeOrderedAndProject" in plan


def test_names_of_one_task_are_dealt_out_before_they_become_postings(spark, tmp_path, monkeypatch):
    seen = []
    postings = names.name_postings
    monkeypatch.setattr(names, "name_postings", lambda table, order: seen.append(table) or postings(table, order))
    table = spark.range(0, 500, 1, 1).selectExpr("id AS line_key", "concat('N', id) AS name")
    names.write_name_index(table, f"{tmp_path}/i")
    assert "RepartitionByExpression [line_key" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert names.indexed_search(spark, f"{tmp_path}/i", "n49", 100).count() == 11
