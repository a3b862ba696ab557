"""Merged daily states against one pass and exact counts."""

import random

import pytest
from busweave.operators import digests
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        day = rng.choice(["01-01", "01-01", "01-02", "01-03"])
        size = rng.choice([3, 5, 5, 40, rng.randrange(60)])
        payload = " ".join(f"{rng.randrange(256):02x}" for _ in range(size)) if i % 10 else "01 02"
        rows.append((day, 191 + int(rng.expovariate(0.7)) % 9, i % 3 if i % 50 else None, payload))
    rows.append((None, 1, 1, None))
    return spark.createDataFrame(rows, "day string, service_id bigint, method_id bigint, payload string").cache()


def test_merged_days_equal_one_pass(spark, messages, tmp_path):
    digests.digests(messages, ["day"]).write.parquet(f"{tmp_path}/days")
    days = spark.read.parquet(f"{tmp_path}/days")
    assert days.count() == 4
    both = []
    for states in (digests.merged(days), digests.digests(messages.withColumn("all", F.lit(1)), ["all"])):
        row = states.select("messages", digests.distinct_payloads().alias("n"), digests.size_quantile(0.5).alias("half")).first()
        pairs = {r["pair"]: r["messages_of_pair"] for r in digests.frequent_pairs(states, 5).collect()}
        both.append((row["messages"], row["n"], pairs))
        sizes = sorted(0 if not r["payload"] else len(r["payload"].split()) for r in messages.collect())
        low, high = (sizes[int(len(sizes) * (0.5 + e))] for e in (-digests.RANK_ERROR, digests.RANK_ERROR))
        assert low <= row["half"] <= high
    assert both[0] == both[1]
    exact = messages.select("payload").distinct().filter("payload IS NOT NULL").count()
    assert abs(both[0][1] - exact) <= digests.DISTINCT_ERROR * exact


def test_frequent_pairs_per_day(messages):
    days = digests.digests(messages, ["day"])
    want = {}
    for r in messages.collect():
        if r["service_id"] is not None and r["method_id"] is not None:
            key = (r["day"], f"{r['service_id']}/{r['method_id']}")
            want[key] = want.get(key, 0) + 1
    got = {(r["day"], r["pair"]): r["messages_of_pair"] for r in digests.frequent_pairs(days, 100).collect()}
    assert got == want


def test_states_are_read_without_messages(spark, messages, tmp_path):
    digests.digests(messages, ["day"]).write.parquet(f"{tmp_path}/days")
    plan = digests.merged(spark.read.parquet(f"{tmp_path}/days"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Python" not in plan
