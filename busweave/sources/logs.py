"""Log text and name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from busweave.functions.text import log_timestamp, strip


def read_log_lines(spark: SparkSession, path: str, anchor_year: int = 1900) -> DataFrame:
    """``(file_path, line_key, value, ts)``; bad UTF-8 is replaced.

    ``line_key`` orders lines within a file.  Rows of one file block are read
    in order by one task, so (file, block, running id) is order without a sort.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_key"),
        F.make_valid_utf8("value").alias("value"),
    )
    return raw.withColumn("ts", log_timestamp(F.col("value"), anchor_year))


def nonblank_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines stripped, blank ones dropped."""
    return lines.withColumn(column, strip(F.col(column))).filter(F.col(column) != "")


def read_nonblank_lines(spark: SparkSession, path: str) -> DataFrame:
    return nonblank_lines(read_log_lines(spark, path))


def read_signal_names(spark: SparkSession, path: str) -> DataFrame:
    """``(line_key, name)`` of a name list, one name per line."""
    lines = read_nonblank_lines(spark, path)
    return lines.select("line_key", F.col("value").alias("name"))
