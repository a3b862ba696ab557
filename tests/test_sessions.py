"""Sessions, silences, bursts and overlaps over many slots, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from busweave.operators import overlap, series, sessions
from pyspark.sql import functions as F

START = datetime(1999, 12, 31, 23, 59, 0)
SCHEMA = "query_signal string, ts timestamp_ntz, line_no bigint, value double"


def rows(seed, count=400, span=2000):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        key = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        ts = START + timedelta(seconds=rng.randrange(span), microseconds=rng.choice([0, 0, 500_001]))
        out.append((key, ts, i, float(rng.randrange(3))))
    out.append(("single", START, count, 1.0))
    out.append(("a", None, count + 1, 1.0))
    rng.shuffle(out)
    return out


def plain_sessions(data, gap):
    groups = {}
    for r in sorted((r for r in data if r[1] is not None), key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    found, member = [], {}
    for key, group in groups.items():
        start = None
        for i, r in enumerate(group):
            if i == 0 or r[1] - group[i - 1][1] > timedelta(seconds=gap):
                start = r[1]
                found.append([key, start, r[1], 0])
            found[-1][2], found[-1][3] = r[1], found[-1][3] + 1
            member[r[2]] = start
    return sorted(map(tuple, found), key=str), member


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("slot", [7, 100_000])
def test_sessions_and_silences(spark, seed, slot):
    data, gap = rows(seed), 6
    frame = spark.createDataFrame(data, SCHEMA)
    want, member = plain_sessions(data, gap)
    got = sessions.sessions(frame, gap=gap, slot_seconds=slot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    timed = frame.filter("ts IS NOT NULL")
    marked = sessions.with_sessions(timed, gap=gap, slot_seconds=slot)
    assert {r["line_no"]: r["session"] for r in marked.collect()} == member
    quiet = sorted((tuple(r) for r in sessions.silences(got).collect()), key=str)
    plain = [
        (a[0], a[2], b[1], (b[1] - a[2]).total_seconds())
        for a in want for b in want if a[0] == b[0] and b[1] == min((c[1] for c in want if c[0] == a[0] and c[1] > a[1]), default=None)
    ]
    assert quiet == sorted(plain, key=str)


def test_sessions_equal_spark_windows(spark):
    """The rule of session_window, also where a silence is exactly the gap."""
    data = [("s", START + timedelta(seconds=t), i, 0.0) for i, t in enumerate([0, 5, 10, 15.5, 20.5, 100, 105.000001])]
    frame = spark.createDataFrame(data, SCHEMA)
    timed = frame.withColumn("at", F.col("ts").cast("timestamp"))
    native = timed.groupBy("query_signal", F.session_window("at", "5 seconds")).agg(F.min("ts"), F.max("ts"), F.count("*"))
    want = sorted((r[0], r[2], r[3], r[4]) for r in native.collect())
    assert sorted(tuple(r) for r in sessions.sessions(frame, gap=5, slot_seconds=4).collect()) == want


def test_bursts(spark):
    found = spark.createDataFrame(
        [("a", START, START, 3), ("b", START, START + timedelta(seconds=10), 3), ("c", START, START + timedelta(seconds=1), 2)],
        "query_signal string, ts timestamp_ntz, until timestamp_ntz, samples bigint",
    )
    assert {r["query_signal"] for r in sessions.bursts(found, least=3, rate=1).collect()} == {"a"}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("slot", [5, 100_000])
def test_overlap(spark, seed, slot):
    rng = random.Random(seed)
    sides = []
    for _ in range(2):
        steps = []
        for key in ("hot", "a", None):
            at = START
            for i in range(120 if key == "hot" else 10):
                at += timedelta(seconds=rng.choice([0, 0, 1, 3, 400]))
                until = at + timedelta(seconds=rng.choice([0, 1, 2, 5, 300]))
                steps.append((key, at, until, float(i) if i % 5 else None))
                at = until
        rng.shuffle(steps)
        sides.append(steps)
    schema = "k string, ts timestamp_ntz, until timestamp_ntz, value double"
    left, right = (spark.createDataFrame(s, schema) for s in sides)
    want = sorted(
        (
            (a[0], max(a[1], b[1]), min(a[2], b[2]), a[3], b[3])
            for a in sides[0] for b in sides[1] if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])
        ),
        key=str,
    )
    got = overlap.held_together(left, right, ["k"], slot_seconds=slot)
    assert got.columns == ["k", "ts", "until", "left_value", "right_value"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert overlap.held_together(left.limit(0), right, ["k"]).count() == 0


def test_plans_join_nothing_and_shuffle_points_once(spark):
    frame = spark.createDataFrame(rows(1), SCHEMA).filter("ts IS NOT NULL")
    steps = series.step_intervals(frame)
    plan = overlap.held_together(steps, steps, ["query_signal"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan
    plan = series.change_points(frame)._jdf.queryExecution().executedPlan().toString()
    # all points by (slot, key); then only the points left, by border group
    assert plan.count("Exchange hashpartitioning") == 2 and "rangepartitioning" not in plan


@pytest.mark.parametrize("slot", [3, 3600, None])
def test_slots_do_not_change_results(spark, slot):
    data = [r for r in rows(5, span=60) if r[1] is not None]
    frame = spark.createDataFrame(data, SCHEMA)
    key = lambda f: sorted((tuple(r) for r in f.collect()), key=str)
    names = ["query_signal", "ts", "line_no", "value"]
    assert key(series.change_points(frame, slot_seconds=slot).select(names)) == key(series.change_points(frame, slot_seconds=None).select(names))
    wide = [*names, "until"]
    assert key(series.step_intervals(frame, slot_seconds=slot).select(wide)) == key(series.step_intervals(frame, slot_seconds=None).select(wide))
