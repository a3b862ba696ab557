"""Order-dependent operators over many chunks, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from busweave.operators import ordered, series

START = datetime(1900, 1, 1)


@pytest.fixture()
def many_chunks(spark):
    """Keep every range partition apart, as on a large input."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def series_rows(seed, count=400):
    """One key holds most rows; another has a single row."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        key = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", "c"])
        ts = START + timedelta(seconds=rng.randrange(count // 4))
        rows.append((key, ts, i, float(rng.randrange(2) if rng.random() < 0.9 else 5)))
    rows.append(("single", START, count, 1.0))
    rng.shuffle(rows)
    return rows


SCHEMA = "query_signal string, ts timestamp_ntz, line_no bigint, value double"


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def chunk_count(spark, frame):
    spread = ordered._chunked(frame, ["query_signal"], ["ts", "line_no"])
    return spread.select("_chunk").distinct().count()


@pytest.mark.parametrize("seed", range(4))
def test_change_points_and_steps(many_chunks, seed):
    rows = series_rows(seed)
    frame = many_chunks.createDataFrame(rows, SCHEMA)
    assert chunk_count(many_chunks, frame) > 4
    points, steps = set(), set()
    for group in by_key(rows).values():
        kept = [r for i, r in enumerate(group) if i == 0 or r[3] != group[i - 1][3]]
        points |= set(kept)
        for i, row in enumerate(kept):
            until = kept[i + 1][1] if i + 1 < len(kept) else group[-1][1]
            steps.add((*row, until))
    assert {tuple(r) for r in series.change_points(frame).collect()} == points
    got = series.step_intervals(frame).select("query_signal", "ts", "line_no", "value", "until")
    assert {tuple(r) for r in got.collect()} == steps


@pytest.mark.parametrize("seed", range(4))
def test_asof(many_chunks, seed):
    rows = series_rows(seed, 120)
    rng = random.Random(seed + 100)
    probes = [
        (i, rng.choice(["hot", "a", "b", "none"]), START + timedelta(seconds=rng.randrange(-5, 40)))
        for i in range(300)
    ]
    want = {}
    for i, key, ts in probes:
        before = [r for r in by_key(rows).get(key, []) if r[1] <= ts]
        want[i] = before[-1][3] if before else None
    got = series.asof_signal_value(
        many_chunks.createDataFrame(rows, SCHEMA),
        many_chunks.createDataFrame(probes, "probe_id bigint, query_signal string, ts timestamp_ntz"),
    )
    assert {r["probe_id"]: r["value"] for r in got.collect()} == want


def test_asof_with_file_order_keys(spark):
    points = spark.createDataFrame(
        [("s", START, ("f", 1), 1.0), ("s", START, ("f", 2), 2.0)],
        "query_signal string, ts timestamp_ntz, line_no struct<file string, seq int>, value double",
    )
    probes = spark.createDataFrame(
        [("p", "s", START), ("q", "s", START - timedelta(seconds=1))],
        "probe_id string, query_signal string, ts timestamp_ntz",
    )
    got = {r["probe_id"]: r["value"] for r in series.asof_signal_value(points, probes).collect()}
    assert got == {"p": 2.0, "q": None}


@pytest.mark.parametrize("seed", range(3))
def test_carry_forward(many_chunks, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("xy"), i, i if rng.random() < 0.05 else None) for i in range(500)]
    frame = many_chunks.createDataFrame(rows, "sheet string, row_no bigint, v bigint")
    last, want = {}, {}
    for sheet, i, v in rows:
        last[sheet] = v if v is not None else last.get(sheet)
        want[i] = last[sheet]
    got = ordered.carry_forward(frame.repartition(5), ["sheet"], ["row_no"], "v", "filled")
    assert {r["row_no"]: r["filled"] for r in got.collect()} == want


def test_global_position(many_chunks):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i) for i in range(700)]
    frame = many_chunks.createDataFrame(rows, "length int, line_no bigint").repartition(6)
    got = ordered.global_position(frame, ["length", "line_no"], "place")
    want = {row[1]: place for place, row in enumerate(sorted(rows))}
    assert {r["line_no"]: r["place"] for r in got.collect()} == want


def test_equal_runs_and_nulls(spark):
    rows = [("s", START + timedelta(seconds=i), i, v) for i, v in enumerate([1.0, 1.0, 2.0, 2.0, 1.0])]
    got = series.change_points(spark.createDataFrame(rows, SCHEMA)).orderBy("line_no")
    assert [r["value"] for r in got.collect()] == [1.0, 2.0, 1.0]


def test_no_python_and_no_products_in_plans(spark):
    rows = spark.createDataFrame(series_rows(1), SCHEMA)
    for frame in (series.change_points(rows), series.step_intervals(rows)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "SinglePartition" not in plan and "Python" not in plan
