"""Which values of two signals held at the same time.

Steps of one side do not overlap each other, so at any time at most one step of
either side is in force.  The starts of both sides are merged in time order and
every start carries the step of the other side that is still open; a pair is
found once, at its later start.  The work is one pass over the merged starts:
long steps are carried over slot borders, not copied into the slots they cross,
and a key with a third of all steps spreads over its slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from busweave.operators.ordered import carry_forward
from busweave.operators.windowing import time_chunk


def held_together(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    slot_seconds: int = 600,
) -> DataFrame:
    """``(keys, ts, until, left_value, right_value)`` for each pair of steps that overlap.

    Both sides are ``(keys, ts, until, value)``, as ``step_intervals`` gives them:
    half-open, without overlaps per key on one side.  Steps without a time or of
    no length hold at no time; null keys and values are kept.
    """

    def starts(steps: DataFrame, side: int) -> DataFrame:
        step = F.struct(F.col("until").alias("until"), F.col(value).alias("value"))
        held = (right, left)[side].schema[value].dataType.simpleString()
        other = F.lit(None).cast(f"struct<until:timestamp_ntz,value:{held}>")
        return steps.filter(F.col("until") > F.col("ts")).select(
            *keys, "ts", F.lit(side).alias("_side"),
            (other if side else step).alias("_left"), (step if side else other).alias("_right"),
        )

    merged = starts(left, 0).union(starts(right, 1))
    order, chunk = ["ts", "_side"], time_chunk("ts", slot_seconds)
    carried = carry_forward(merged, keys, order, "_left", "_l", chunk=chunk)
    carried = carry_forward(carried, keys, order, "_right", "_r", chunk=chunk)
    until = F.least("_l.until", "_r.until")
    return carried.filter(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (until > F.col("ts"))).select(
        *keys, "ts", until.alias("until"),
        F.col("_l.value").alias("left_value"), F.col("_r.value").alias("right_value"),
    )
