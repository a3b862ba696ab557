"""Sessions of samples: runs without a silence, the silences between them, bursts.

A session breaks where more than ``gap`` seconds pass without a sample, the rule
of Spark's own ``session_window``, which the stream form uses.  There a key's rows
meet in one task; here sessions are cut at time slots first, so that a key with a
third of all samples spreads over its slots, and only the pieces, one per session
and slot, are merged across slot borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busweave.operators.ordered import carry_forward, with_neighbours
from busweave.operators.windowing import micros, time_chunk


def _breaks(before: Column, now: str, gap: float) -> Column:
    """True at the first sample and after a silence."""
    return before.isNull() | (micros(now) - micros(before) > round(gap * 1_000_000))


def sessions(
    points: DataFrame,
    keys: Sequence[str] = ("query_signal",),
    gap: float = 1.0,
    time: str = "ts",
    slot_seconds: int = 600,
) -> DataFrame:
    """``(keys, ts, until, samples)``: first and last sample time and their number per session.

    Rows without a time belong to no session; equal times are one session.
    """
    slots = points.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("ts"), time_chunk(time, slot_seconds).alias("_slot")
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy("ts")
    starts = slots.withColumn("_new", _breaks(F.lag("ts").over(inside), "ts", gap).cast("int"))
    numbered = starts.withColumn("_piece", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*keys, "_slot", "_piece").agg(
        F.min("ts").alias("ts"), F.max("ts").alias("until"), F.count("*").alias("samples")
    )
    seen = with_neighbours(
        pieces.drop("_piece"), keys, ["ts"], ["until"], chunk=F.col("_slot")
    )
    first = F.when(_breaks(F.col("_previous.until"), "ts", gap), F.col("ts"))
    marked = seen.withColumn("_first", first).drop("_previous", "_following")
    merged = carry_forward(marked, keys, ["ts"], "_first", "_start", chunk=F.col("_slot"))
    return merged.groupBy(*keys, F.col("_start").alias("ts")).agg(
        F.max("until").alias("until"), F.sum("samples").alias("samples")
    )


def with_sessions(
    points: DataFrame,
    keys: Sequence[str] = ("query_signal",),
    gap: float = 1.0,
    order: Sequence[str] = ("ts", "line_no"),
    name: str = "session",
    slot_seconds: int = 600,
) -> DataFrame:
    """Points with the first sample time of their session; ``order`` begins with the time."""
    time = order[0]
    chunk = time_chunk(time, slot_seconds)
    seen = with_neighbours(points, keys, order, [time], chunk=chunk)
    first = F.when(_breaks(F.col("_previous")[time], time, gap), F.col(time))
    marked = seen.withColumn("_first", first).drop("_previous", "_following")
    return carry_forward(marked, keys, order, "_first", name, chunk=chunk).drop("_first")


def silences(found: DataFrame, keys: Sequence[str] = ("query_signal",), slot_seconds: int = 3600) -> DataFrame:
    """``(keys, ts, until, seconds)``: from the end of a session to the start of the next."""
    seen = with_neighbours(
        found, keys, ["ts"], ["ts"], keep=lambda _, after: after.isNotNull(), chunk=time_chunk("ts", slot_seconds)
    )
    after = F.col("_following.ts")
    return seen.select(
        *keys, F.col("until").alias("ts"), after.alias("until"),
        ((micros(after) - micros("until")) / 1_000_000).alias("seconds"),
    )


def bursts(found: DataFrame, least: int, rate: float) -> DataFrame:
    """Sessions of at least ``least`` samples that come at ``rate`` a second or more."""
    span = (micros("until") - micros("ts")) / 1_000_000
    return found.filter((F.col("samples") >= least) & (F.col("samples") - 1 >= span * rate))
