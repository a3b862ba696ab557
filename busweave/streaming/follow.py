"""The stateless steps over a growing log folder, written as they appear.

Extraction and decoding need no order, so they run unchanged on a stream; the
definitions are a static side.  Order-dependent steps stay batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from busweave.functions.text import log_timestamp
from busweave.operators.messages import extract_messages
from busweave.plans.analysis import decode_messages


def follow_log_lines(
    spark: SparkSession, folder: str, anchor_year: int = 1900, files_per_batch: int = 1000
) -> DataFrame:
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select(F.make_valid_utf8("value").alias("value"))
    )
    return lines.withColumn("ts", log_timestamp(F.col("value"), anchor_year))


def follow_decoded(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    return decode_messages(extract_messages(lines), definitions)


def append_json(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append rows to a JSON folder; each file is written exactly once."""
    writer = (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
