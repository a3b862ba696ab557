import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from busweave.operators import windowing as W

NOON = datetime(1900, 6, 1, 12)
TARGET = "timestamp_ntz'1900-06-01 12:00:00'"


def scan(lines):
    """The rule read line by line: start at a hit, stop past the window."""
    kept, low, high = [], NOON - timedelta(seconds=5), NOON + timedelta(seconds=5)
    for number, ts in lines:
        if ts is None:
            if kept:
                kept.append(number)
        elif low <= ts <= high:
            kept.append(number)
        elif ts > high and kept:
            break
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_slice_equals_scan(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for file in range(60):
        lines = []
        for number in range(rng.randint(1, 15)):
            kind = rng.random()
            ts = None if kind < 0.3 else NOON + timedelta(seconds=rng.choice([-30, -5, -1, 0, 5, 6, 40]))
            lines.append((number, ts))
        rows += [(f"f{file}", n, ts) for n, ts in lines]
        want |= {(f"f{file}", n) for n in scan(lines)}
    frame = spark.createDataFrame(rows, "file_path string, line_key bigint, ts timestamp_ntz")
    got = W.window_with_continuations(frame.repartition(4), F.expr(TARGET))
    assert {(r["file_path"], r["line_key"]) for r in got.collect()} == want


def test_lines_of_one_file_meet_its_window_in_many_tasks(spark):
    """A log may be one file: no task has to hold, or sort, all its lines."""
    frame = spark.range(0, 8000, 1, 4).selectExpr(
        "'f' AS file_path", "id AS line_key",
        f"CASE WHEN id = 0 THEN {TARGET} WHEN id >= 6000 THEN {TARGET} + INTERVAL 1 HOUR END AS ts",
    )
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = W.window_with_continuations(frame, F.expr(TARGET))
        tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert got.columns == frame.columns
        assert sorted(r["line_key"] for r in got.collect()) == list(range(6000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 3000


def test_window_ends_are_inside(spark):
    rows = [(s, NOON + timedelta(seconds=s)) for s in (-6, -5, 0, 5, 6)] + [(99, None)]
    frame = spark.createDataFrame(rows, "n bigint, ts timestamp_ntz")
    got = W.filter_time_window(frame, F.expr(TARGET))
    assert sorted(r["n"] for r in got.collect()) == [-5, 0, 5]


@pytest.mark.parametrize("seconds", [0, 0.5, 5, 61.25])
def test_many_windows_equal_pairwise_test(spark, seconds):
    rng = random.Random(5)
    at = lambda: NOON + timedelta(milliseconds=rng.randrange(-300_000, 300_000))
    lines = [(i, at()) for i in range(300)] + [(300 + i, None) for i in range(3)]
    targets = [(i, at()) for i in range(20)] + [(20, lines[0][1]), (21, None)]
    want = {
        (t, n) for t, centre in targets for n, ts in lines
        if centre and ts and abs(ts - centre) <= timedelta(seconds=seconds)
    }
    got = W.filter_time_windows(
        spark.createDataFrame(lines, "n bigint, ts timestamp_ntz"),
        spark.createDataFrame(targets, "target_id bigint, target_ts timestamp_ntz"),
        seconds,
    )
    rows = [(r["target_id"], r["n"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
