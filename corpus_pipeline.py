"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.  ``run`` writes every
stage's result as Parquet below the shared folder and reads it back as the next
one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from busweave.llm.decontaminate import drop_contaminated
from busweave.llm.minhash import first_rows
from busweave.llm.packing import pack
from busweave.llm.quality import classify
from busweave.llm.secrets import redact, scan_secrets
from busweave.session import settle

#: SQL expresses neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None

#: Stages on word shingles take a similarity of 0.8; 45 bands of 6 rows miss such a pair with probability 1.2e-6.
PERCENT, BANDS, ROWS = 80, 45, 6


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: neither junk nor toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    return classify(named, labels, carry=["row"]).filter("keep").select("row.*")


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest id."""
    return first_rows(docs, percent=PERCENT, bands=BANDS, rows=ROWS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    found = scan_secrets(docs, out="__spans")
    clean = redact(F.col("text"), F.col("__spans"))
    changed = F.size("__spans") > 0
    return found.withColumn("__clean", clean).select(*[
        F.col("__clean").alias("text") if c == "text"
        else F.when(changed, F.length("__clean")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(c)
        for c in docs.columns
    ])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", first_of_near_duplicates),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
