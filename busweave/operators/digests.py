"""Small mergeable states of message tables, one row per day.

A day is read once.  Its states (distinct payloads, payload sizes, frequent
service and method pairs) are written, and any span of days is answered by
merging their rows, without the messages.  Every state has a fixed size bound
whatever the day holds, and is built per task and merged after the shuffle, so a
day with a third of all messages moves as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from busweave.functions.frames import payload_bytes

#: Registers (as a power of two), accuracy and number of counters of the states.
LG_REGISTERS, ACCURACY, COUNTERS = 12, 200, 1024
#: Error of the distinct count at two standard deviations, and of a rank in the sizes.
DISTINCT_ERROR, RANK_ERROR = 2 * 1.04 / 64, 0.02


def pair_name(service: str = "service_id", method: str = "method_id") -> Column:
    """A (service, method) pair as one text; null without both ids."""
    return F.concat(F.col(service).cast("string"), F.lit("/"), F.col(method).cast("string"))


def digests(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, messages, payload_state, size_state, pair_state)`` of the messages of each ``by``."""
    sized = messages.withColumns(
        {"_size": F.size(payload_bytes(F.col("payload"))).cast("bigint"), "_pair": pair_name()}
    )
    return sized.groupBy(*by).agg(
        F.count("*").alias("messages"),
        F.hll_sketch_agg("payload", LG_REGISTERS).alias("payload_state"),
        F.kll_sketch_agg_bigint("_size", ACCURACY).alias("size_state"),
        F.expr(f"approx_top_k_accumulate(_pair, {COUNTERS}) FILTER (WHERE _pair IS NOT NULL)").alias("pair_state"),
    )


def merged(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of several days as those of the whole span, or of each ``by``."""
    return states.groupBy(*by).agg(
        F.sum("messages").alias("messages"),
        F.hll_union_agg("payload_state").alias("payload_state"),
        F.kll_merge_agg_bigint("size_state", ACCURACY).alias("size_state"),
        F.expr(f"approx_top_k_combine(pair_state, {COUNTERS})").alias("pair_state"),
    )


def distinct_payloads() -> Column:
    """Estimated number of distinct payloads of a state."""
    return F.hll_sketch_estimate("payload_state")


def size_quantile(share: float) -> Column:
    """Payload size that about ``share`` of the messages do not exceed."""
    return F.kll_sketch_get_quantile_bigint("size_state", F.lit(share))


def frequent_pairs(states: DataFrame, k: int = 10) -> DataFrame:
    """``(columns of the state's row, pair, messages_of_pair)`` of the ``k`` most frequent pairs."""
    others = [c for c in states.columns if not c.endswith("_state")]
    top = F.inline(F.expr(f"approx_top_k_estimate(pair_state, {k})")).alias("pair", "messages_of_pair")
    return states.select(*others, top)
