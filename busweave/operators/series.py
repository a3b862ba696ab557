"""Decoded values as time series per signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from busweave import constants as K
from busweave.functions.text import log_timestamp
from busweave.operators.lookup import first_match_per_key
from busweave.operators.ordered import carry_forward, with_neighbours
from busweave.operators.windowing import filter_time_window, time_chunk

SLOT_SECONDS = 600


def all_points(
    decoded: DataFrame, anchor_year: int = 1900, scope: Sequence[str] = ()
) -> DataFrame:
    """``(query_signal, ts, line_no, value)`` of rows that have a value and a time.

    ``scope`` columns, such as the log's path, stay in front; put them into the
    ``keys`` of the steps below to treat each log for itself.
    """
    return decoded.filter(
        F.col("query_signal").isNotNull() & F.col("match_value").isNotNull()
    ).select(
        *scope,
        "query_signal",
        log_timestamp(F.col("time"), anchor_year).alias("ts"),
        "line_no",
        F.col("match_value").alias("value"),
    ).filter(F.col("ts").isNotNull())


def signal_points(
    decoded: DataFrame,
    target: Column,
    seconds: float = K.WINDOW_SECONDS,
    anchor_year: int = 1900,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Points around a target time; out-of-range values stay, unlabelled ones go."""
    return filter_time_window(all_points(decoded, anchor_year, scope), target, seconds)


def rows_by_signal(decoded: DataFrame) -> DataFrame:
    """Decoded rows that belong to a requested signal.

    The grouping stays a column: a signal may own any number of rows, which one
    collected list could not hold.
    """
    return decoded.filter(F.coalesce("query_signal", F.lit("")) != "")


def _slot(rows: DataFrame, time: str, seconds: int | None) -> Column | None:
    """Time slots as chunks, if the order begins with a time."""
    timed = isinstance(rows.schema[time].dataType, (T.TimestampNTZType, T.TimestampType))
    return time_chunk(F.col(time).cast("timestamp_ntz"), seconds) if seconds and timed else None


def _differs(value: str):
    return lambda before: before.isNull() | ~F.col(value).eqNullSafe(before[value])


def change_points(
    points: DataFrame,
    keys: Sequence[str] = ("query_signal",),
    order: Sequence[str] = ("ts", "line_no"),
    value: str = "value",
    slot_seconds: int | None = SLOT_SECONDS,
) -> DataFrame:
    """First point of each signal and every point that differs from the one before.

    Points of one time slot and signal meet in one task; without slots, or if
    ``order`` does not begin with a time, they are spread by range.
    """
    differs = _differs(value)
    marked = with_neighbours(
        points, keys, order, [value], keep=lambda before, _: differs(before),
        chunk=_slot(points, order[0], slot_seconds),
    )
    return marked.drop("_previous", "_following")


def step_intervals(
    points: DataFrame,
    keys: Sequence[str] = ("query_signal",),
    order: Sequence[str] = ("ts", "line_no"),
    value: str = "value",
    time: str = "ts",
    slot_seconds: int | None = SLOT_SECONDS,
) -> DataFrame:
    """``until``: a change point holds to the next, the last to the last sample.

    The last sample of a signal stays in the plan as an end marker, so no second
    aggregate over all points is needed.
    """
    differs = _differs(value)
    marked = with_neighbours(
        points, keys, order, [value],
        keep=lambda before, after: differs(before) | after.isNull(),
        chunk=_slot(points, order[0], slot_seconds),
    )
    steps = marked.withColumn("_step", differs(F.col("_previous"))).drop(
        "_previous", "_following"
    )
    held = with_neighbours(steps, keys, order, [time], chunk=_slot(steps, order[0], slot_seconds))
    return (
        held.filter("_step")
        .withColumn("until", F.coalesce(F.col("_following")[time], F.col(time)))
        .drop("_step", "_previous", "_following")
    )


def asof_signal_value(
    points: DataFrame, probes: DataFrame, key: str = "query_signal",
    slot_seconds: int | None = SLOT_SECONDS,
) -> DataFrame:
    """Value in force at each probe(probe_id, key, ts): last point not after it.

    Points and probes are merged in time order and values carried forward, so
    neither side is paired with the other.
    """
    place, value = points.schema["line_no"].dataType, points.schema["value"].dataType
    merged = points.select(
        key, "ts", F.lit(0).alias("_is_probe"), "line_no",
        F.struct("value").alias("_point"),
        F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"),
    ).unionByName(
        probes.select(
            key, "ts", F.lit(1).alias("_is_probe"),
            F.lit(None).cast(place).alias("line_no"),
            F.when(F.lit(False), F.struct(F.lit(None).cast(value).alias("value"))).alias("_point"),
            "probe_id",
        )
    )
    carried = carry_forward(
        merged, [key], ["ts", "_is_probe", "line_no", "probe_id"], "_point", "_in_force",
        wanted=F.col("_is_probe") == 1, chunk=_slot(merged, "ts", slot_seconds),
    )
    return carried.select(
        "probe_id", key, "ts", F.col("_in_force.value").alias("value")
    )


def signal_scales(decoded: DataFrame, order: str = "line_no") -> DataFrame:
    """Choices and limits of each signal, from its first decoded row."""
    rows = rows_by_signal(decoded).select(
        "query_signal", order, "choices", "minimum", "maximum"
    )
    return first_match_per_key(rows, ["query_signal"], order).drop(order)
