"""Held-out accuracy, shrinkage, odd rows."""

import pytest
from busweave.llm.quality import classify
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    half = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    rows = classify(docs, labels.filter(half)).withColumnRenamed("toxic", "p_toxic")
    held = rows.join(labels.filter(~half), "doc_id").select("quality", "toxic", "keep", "p_toxic").collect()
    clean = [r.keep for r in held if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in held if r.quality == 0]
    toxic = [r.keep for r in held if r.toxic == 1]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.05 * len(junk)
    assert sum(toxic) <= 0.15 * len(toxic)


def test_sparse_sites_shrink(spark, tables):
    docs, labels = tables
    junk = "x### y$$$ z&&& " * 40
    good = docs.filter("doc_id % 7 = 0").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 20))
    extra = spark.createDataFrame(
        [(10**6 + i, junk, "en", "bad", 1) for i in range(300)] + [(2 * 10**6, junk, "en", "tiny", 1)], docs.schema
    )
    rates = {r.source: r.host_rate for r in classify(docs.unionByName(good).unionByName(extra), labels).select("source", "host_rate").distinct().collect()}
    assert rates["bad"] < rates["tiny"] < rates["src1"]


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5, "", "en", None, 0), (5, "word " * 300_000, None, "src1", 1)], docs.schema
    ).withColumn("keep", F.lit("mine"))
    out = classify(odd, labels)
    assert out.count() == 3 and out.filter("posterior IS NULL OR keep IS NULL").count() == 0
    assert classify(odd, labels.filter("false")).filter("keep").count() == 3
    assert classify(odd.filter("false"), labels).count() == 0
