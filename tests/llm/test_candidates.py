"""Semi and anti joins by bounded key tables against plain sets."""

import random

import pytest
from busweave.llm.candidates import possible, without
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [1 << 20, 16])
def test_against_sets(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice([None, *range(-40, 400)]), f"t{i}") for i in range(600)]
    held = [(k, k % 3) for k in range(-40, 100, 7)] + [(3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1))
    keys = spark.createDataFrame(held, "__k long, other long")
    some = {r["text"] for r in possible(docs, F.col("doc_id"), keys, "__k", most).collect()}
    exact = {t for k, t in rows if k in {h[0] for h in held}}
    assert exact <= some and (most == 16 or exact == some)
    same = (F.col("doc_id") == F.col("__k")) & (F.col("other") == 0)
    got = without(docs, F.col("doc_id"), keys, "__k", same, most)
    gone = {k for k, other in held if other == 0}
    assert sorted(r["text"] for r in got.collect()) == sorted(t for k, t in rows if k not in gone)
    assert got.columns == docs.columns


def test_texts_stay_where_they_are(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    keys = spark.createDataFrame([(1,)], "__k long")
    plan = possible(docs, F.col("doc_id"), keys, "__k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
