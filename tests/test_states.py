"""Streams with keyed state against the batch steps: shuffled input, restarts, late rows, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from busweave.operators import series, sessions
from busweave.streaming import states

START = datetime(1999, 6, 1)
SCHEMA = "query_signal string, ts timestamp_ntz, line_no bigint, value double"
KEYS = ("query_signal",)
DELAY = 30


def samples(seed, count=300):
    rng = random.Random(seed)
    out, at = [], START
    for i in range(count):
        at += timedelta(seconds=rng.choice([0, 1, 2, 90]), microseconds=rng.choice([0, 250]))
        out.append((rng.choice(["hot", "hot", "hot", "a", "b"]), at, i, float(rng.randrange(3))))
    return out


def batches(rows, seed, n=5):
    """Rows in arrival order: each at most DELAY seconds behind a later one, in files one after the other."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, DELAY - 1)))
    size = -(-len(late) // n)
    parts = [late[i : i + size] for i in range(0, len(late), size)]
    for part in parts:
        rng.shuffle(part)
    return parts


def write(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def tick(rows):
    return [("end", max(r[1] for r in rows) + timedelta(days=2), None, None)]


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def follow(spark, tmp_path, parts, step):
    """All files through the stream, a new run from the checkpoint after every second file."""
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    progress = []
    for i, part in enumerate(parts):
        write(spark, folder, part)
        if i % 2 and i + 1 < len(parts):
            continue
        query = states.append_table(step(stream(spark, folder)), out, state, available_now=True)
        query.awaitTermination()
        progress += query.recentProgress
    return spark.read.parquet(out), progress


def rows_of(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_change_points(spark, tmp_path):
    rows = samples(1)
    got, progress = follow(spark, tmp_path, [*batches(rows, 1), tick(rows)], lambda s: states.follow_change_points(s, KEYS, f"{DELAY} seconds"))
    columns = ["query_signal", "ts", "line_no", "value"]
    assert rows_of(got, columns) == rows_of(series.change_points(spark.createDataFrame(rows, SCHEMA)), columns)
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 0
    # at the end: one value a key and no buffered rows but the tick's
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 40


@pytest.mark.parametrize("silence", [80, 100_000])
def test_steps(spark, tmp_path, silence):
    rows = samples(2, 160)
    got, _ = follow(spark, tmp_path, [*batches(rows, 2, 3), tick(rows)], lambda s: states.follow_steps(s, KEYS, f"{DELAY} seconds", silence))
    marked = sessions.with_sessions(spark.createDataFrame(rows, SCHEMA), KEYS, silence)
    columns = ["query_signal", "ts", "line_no", "value", "until"]
    assert rows_of(got, columns) == rows_of(series.step_intervals(marked, ("query_signal", "session")), columns)


def test_asof_of_two_streams(spark, tmp_path):
    """Probes ahead of their points wait for them."""
    rows, rng = samples(3, 150), random.Random(30)
    span = (rows[-1][1] - START).total_seconds()
    kind = "probe_id bigint, query_signal string, ts timestamp_ntz"
    probes = [(i, rng.choice(["hot", "a", "none"]), START + timedelta(seconds=rng.uniform(-5, span))) for i in range(80)]
    probes += [(900 + i, r[0], r[1]) for i, r in enumerate(rows[::20])]
    end = tick(rows)[0][1]
    points_in, probes_in, out, state = (f"{tmp_path}/{n}" for n in ("points", "probes", "out", "state"))
    write(spark, probes_in, probes, kind)
    for part in [*batches(rows, 3, 3), tick(rows)]:
        write(spark, points_in, part)
        write(spark, probes_in, [(None, "end", end)], kind)
        joined = states.follow_asof(stream(spark, points_in), stream(spark, probes_in, kind), delay=f"{DELAY} seconds")
        query = states.append_table(joined, out, state, available_now=True)
        query.awaitTermination()
    columns = ["probe_id", "query_signal", "ts", "value"]
    assert sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 0
    want = series.asof_signal_value(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(probes, kind))
    assert rows_of(spark.read.parquet(out), columns) == rows_of(want, columns)
    held = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert held < 40


def test_sessions(spark, tmp_path):
    rows = samples(4, 150)
    got, _ = follow(spark, tmp_path, [*batches(rows, 4, 3), tick(rows)], lambda s: states.follow_sessions(s, KEYS, f"{DELAY} seconds", 60))
    columns = ["query_signal", "ts", "until", "samples"]
    want = sessions.sessions(spark.createDataFrame(rows, SCHEMA), KEYS, 60)
    assert rows_of(got.filter("query_signal <> 'end'"), columns) == rows_of(want, columns)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    first = [("a", START + timedelta(seconds=s), s, float(s)) for s in (0, 100, 200)]
    late = [("a", START + timedelta(seconds=50), 50, 5.0), ("a", START + timedelta(seconds=180), 180, 5.0)]
    dropped = 0
    for part in (first, late, tick(first)):
        write(spark, folder, part)
        query = states.append_table(states.follow_change_points(stream(spark, folder), KEYS, f"{DELAY} seconds"), out, state, available_now=True)
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    got = [(r["line_no"], r["value"]) for r in spark.read.parquet(out).orderBy("ts").collect()]
    assert got == [(0, 0.0), (100, 100.0), (180, 5.0), (200, 200.0)]


def test_results_do_not_depend_on_the_zone(spark, tmp_path):
    """Times in the hour that a zone repeats or skips stay apart and in order."""
    hours = [datetime(2023, 10, 29, 0, 30), datetime(2023, 10, 29, 2, 30), datetime(2023, 10, 29, 2, 45), datetime(2023, 3, 26, 2, 30), datetime(1899, 12, 31, 23, 59, 59, 999999)]
    rows = [("a", at, i, float(i)) for i, at in enumerate(hours)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got, _ = follow(spark, tmp_path, [rows + tick(rows)], lambda s: states.follow_change_points(s, KEYS, "1 second"))
        assert sorted((r["ts"], r["value"]) for r in got.collect()) == sorted((at, float(i)) for i, at in enumerate(hours))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


class Store:
    """A key's list and value state, with the largest number of rows handed over at once."""

    def __init__(self):
        self.rows, self.value, self.most = [], None, 0

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.rows, self.value = [], None

    def appendList(self, rows):
        self.most = max(self.most, len(rows))
        self.rows += rows

    def put(self, rows):
        self.rows = []
        self.appendList(rows)


class Handle:
    def __init__(self):
        self.buffer, self.kept, self.timers = Store(), Store(), []

    def getListState(self, *_):
        return self.buffer

    def getValueState(self, *_):
        return self.kept

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_with_many_rows_is_handed_over_in_parts(spark):
    import pandas as pd

    n, handle = 45_000, Handle()
    step = states.ChangePoints(("k",), ["at_us", "line_no", "value"])
    step.init(handle)
    order = random.Random(7).sample(range(n), n)
    frames = [
        pd.DataFrame({"at_us": order[i : i + 9000], "line_no": order[i : i + 9000], "value": [float(x // 2) for x in order[i : i + 9000]]})
        for i in range(0, n, 9000)
    ] + [pd.DataFrame({"at_us": [5], "line_no": [0], "value": [None]})]
    first = list(step.handleInputRows(("a",), iter(frames), At(0)))
    assert [list(frame["line_no"]) for frame in first] == [[0]]
    assert handle.buffer.most <= 10_000 and handle.timers
    out = pd.concat(step.handleExpiredTimer(("a",), At(10**9), None))
    assert list(out["line_no"]) == list(range(2, n, 2))
    assert set(out["k"]) == {"a"} and not handle.buffer.rows
