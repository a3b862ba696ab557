"""The pipeline's stages on tables with odd rows, and against plain counts."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Results of all stages over documents with odd rows and one more column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, None, None, "src1", 3),
         (10**6 + 2, 'A plain sentence with a token = "abcdef0123456" inside of it.', "en", "src2", 61)], docs.schema
    )
    out = [docs.unionByName(odd).withColumn("keep", F.lit(1))]
    root = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def test_stages_keep_columns_and_shrink(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == stages[0].columns and after.dtypes == stages[0].dtypes
        assert after.count() <= before.count()
    assert stages[3].count() == stages[4].count()


def test_decisions(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].join(labels, "doc_id")
    clean = labels.filter("quality = 1 AND toxic = 0").count()
    assert kept.filter("quality = 1 AND toxic = 0").count() >= 0.98 * clean
    assert kept.filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count()
    texts = [r.text for r in stages[2].filter("text <> ''").collect()]
    assert len(texts) == len(set(texts))
    items = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [" ".join((r.text or "").split()).lower() for r in stages[3].collect()]
    assert not any(item in text for item in items for text in left)
    secret = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    after = stages[4].collect()
    assert not any(secret.search(r.text or "") for r in after)
    assert all(r.n_chars == len(r.text) for r in after if r.text and "[SECRET]" in r.text)
    assert {r.doc_id for r in stages[5].select("doc_id").collect()} == {r.doc_id for r in after}


def test_pairs_between_080_and_085_leave(spark):
    docs = spark.createDataFrame(
        [(i * 2 + side, " ".join([*[f"w{i}x{j}" for j in range(100)], *[f"s{i}{side}t{j}" for j in range(10 if side else 11)]]))
         for i in range(30) for side in (0, 1)], "doc_id long, text string",
    )  # 96 of 117 shingles are shared: 0.82
    left = corpus_pipeline.first_of_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in left) == [2 * i for i in range(30)]


def test_repeated_and_null_ids_are_decided_row_by_row(spark):
    def text(name):
        return " ".join(f"{name}{j}" for j in range(40))

    rows = [(1, text("a"), 1), (2, text("a"), 2), (2, text("b"), 3), (3, text("c"), 4), (3, text("c"), 4), (None, text("d"), 5),
            (None, text("d"), 5), (None, text("a"), 6), (None, text("e"), 7), (4, "", 8), (4, "", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    left = corpus_pipeline.first_of_near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(r.n for r in left.collect()) == [1, 3, 4, 5, 7, 8, 8, 9]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item, 1), (None, text("a"), 2), (7, item, 3), (7, text("b"), 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r.n for r in corpus_pipeline.without_benchmarks(spark, docs, SF).collect()) == [2, 4, 5]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
