"""Years of logs without any, against a plain scan."""

import random
from datetime import datetime, timedelta

import pytest
from busweave.operators import years
from busweave.operators.ordered import running_sum
from pyspark.sql import functions as F

SCHEMA = "file_path string, line_key bigint, ts timestamp_ntz"


def anchored(ts):
    return ts.replace(year=2000)


def log(rng, name, start, lines):
    """True times; some lines are up to 20 hours late."""
    at, out = start, []
    for i in range(lines):
        at += timedelta(hours=rng.choice([1, 5, 90]))
        true = at - timedelta(hours=rng.choice([0, 0, 0, 20]))
        out.append((name, i, None if rng.random() < 0.1 else true))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunked", [False, True])
def test_true_years_come_back(spark, seed, chunked):
    rng = random.Random(seed)
    true = log(rng, "long", datetime(2018, 11, 3), 900) + log(rng, "leap", datetime(2019, 12, 20), 70) + log(rng, "short", datetime(2018, 3, 1), 5)
    start = {"long": 2018, "leap": 2018, "short": 2018}
    true = [(f, k, t and t.replace(year=t.year - 1) if f == "leap" and not (t and (t.month, t.day) == (2, 29)) else t) for f, k, t in true]
    rows = [(f, k, t and anchored(t)) for f, k, t in true]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    chunk = F.floor(F.col("line_key") / 50) if chunked else None
    got = {(r["file_path"], r["line_key"]): (r["year"], r["ts"]) for r in years.with_years(frame, 2018, chunk=chunk).collect()}
    assert len(got) == len(rows) and start
    for f, k, t in true:
        if t is None:
            assert got[f, k] == (None, None)
        elif (t.month, t.day) != (2, 29) or f != "leap":
            assert got[f, k] == (t.year, t)


def test_leap_day_only_where_it_exists(spark):
    rows = [("f", 0, datetime(2000, 2, 29, 8)), ("f", 1, datetime(2000, 1, 5)), ("f", 2, datetime(2000, 2, 29, 9))]
    got = years.with_years(spark.createDataFrame(rows, SCHEMA), 2019).orderBy("line_key").collect()
    assert [(r["year"], r["ts"]) for r in got] == [(2019, None), (2020, datetime(2020, 1, 5)), (2020, datetime(2020, 2, 29, 9))]


def test_microseconds_and_empty_table(spark):
    at = datetime(2000, 5, 6, 7, 8, 9, 123456)
    frame = spark.createDataFrame([("f", 0, at)], SCHEMA)
    assert years.with_years(frame, 2021).first()["ts"] == at.replace(year=2021)
    assert years.with_years(frame.limit(0), 2021).count() == 0


@pytest.mark.parametrize("chunked", [False, True])
def test_running_sum(spark, chunked):
    rng = random.Random(2)
    rows = [(rng.choice("xyyy"), i, rng.choice([None, -1, 2, 5])) for i in range(700)]
    total, want = {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        want[i] = total[k]
    chunk = F.floor(F.col("i") / 40) if chunked else None
    got = running_sum(spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(6), ["k"], ["i"], "v", "s", chunk=chunk)
    assert {r["i"]: r["s"] for r in got.collect()} == want
