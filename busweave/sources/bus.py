"""Bus messages and their signals from flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from busweave.operators.lookup import left_join_large_right


def join_bus_messages(messages: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per message and signal; messages without signals keep one row.

    ``messages``: message_no, name, frame_id, senders, receivers.
    ``signals``: message_no, signal_no, signal, start, length, choices.
    """
    return left_join_large_right(messages, signals, "message_no")


def read_bus_messages(spark: SparkSession, messages: str, signals: str) -> DataFrame:
    return join_bus_messages(spark.read.parquet(messages), spark.read.parquet(signals))
