"""Accuracy and size reports on several levels at once.

Every row is expanded once per grouping set and aggregated in a single shuffle;
partial sums inside tasks keep that shuffle to one row per group and task.
``level_of`` tells a null that means "all" from a null value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from busweave.functions.frames import payload_bytes
from busweave.operators.accuracy import LEVELS


def grouped(rows: DataFrame, sets: Sequence[Sequence[str]], *aggregates) -> DataFrame:
    """``rows`` by each set of columns, with ``level_of``: a bit per column, set where it is summed over."""
    columns = list(dict.fromkeys(c for one in sets for c in one))
    return rows.groupingSets([[F.col(c) for c in one] for one in sets], *columns).agg(
        F.grouping_id(*columns).alias("level_of"), *aggregates
    )


def accuracy_rollup(
    levels: DataFrame,
    sets: Sequence[Sequence[str]] = (("log",), ("log", "service_id"), ("service_id", "method_id"), ("type",), ()),
) -> DataFrame:
    """Counts per accuracy level and the share of exact rows, per set of columns.

    ``levels`` are truth rows with their ``level`` (``accuracy_levels``).
    """
    counted = grouped(
        levels, sets, F.count("*").alias("truth_rows"),
        *[F.count_if(F.col("level") == name).alias(f"{name}_rows") for name in LEVELS],
    )
    return counted.withColumn("accuracy", F.col("exact_rows") / F.col("truth_rows") * 100)


def payload_size_rollup(
    messages: DataFrame,
    sets: Sequence[Sequence[str]] = (("type", "service_id", "method_id"), ("type", "service_id"), ("type",), ()),
) -> DataFrame:
    """Messages, bytes and extreme sizes of payloads per set of columns."""
    sized = messages.withColumn("_bytes", F.size(payload_bytes(F.col("payload"))))
    return grouped(
        sized, sets, F.count("*").alias("messages"), F.sum("_bytes").alias("bytes"),
        F.min("_bytes").alias("least_bytes"), F.max("_bytes").alias("most_bytes"),
    )
