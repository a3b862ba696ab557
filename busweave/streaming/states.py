"""Order-dependent steps over a stream, by keyed state and event time.

Rows of a key may arrive in any order within the watermark's delay.  The state
of a key buffers them until the watermark has passed, then takes them in the
order of ``(ts, tie)``, so the results are those of the batch steps in
``operators.series`` and ``operators.sessions``.

- A row at or before the watermark when it arrives is late: Spark drops it and
  counts it (``numRowsDroppedByWatermark``), and nothing already emitted changes.
- The state of a key is its rows inside the delay plus one row of what came last.
  A timer at the earliest buffered row wakes a key that gets no further input.
- A point whose value is null is a clock tick: it moves the watermark and is no
  sample.  A log that ends is completed by one tick past its end.

Times, from 1850 to 2140, are carried as microseconds, so results do not depend
on the session's time zone.  Keyed state needs the RocksDB store, which ``append_table`` sets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from busweave.operators.windowing import from_micros, micros

# processors travel to the executors by value, which then need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EVENT = "event_time"
#: Rows that are Python objects at once, on their way from and to the state store.
_SLICE = 10_000


#: Event times count from 1850: a watermark starts in 1970, and what lies before it is late.
_SHIFT = 43_829 * 86_400_000_000


def _since(ts: str) -> Column:
    return micros(ts) + _SHIFT


def _time(at: str) -> Column:
    return from_micros(f"{at} - {_SHIFT}")


def _watermarked(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn(_EVENT, F.timestamp_micros("at_us")).withWatermark(_EVENT, delay)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``take`` in order, once the watermark has passed them.

    ``row`` is the schema of a buffered row, whose first column is its time and
    whose first ``order`` columns sort it; ``kept`` is the schema of the state
    between rows.
    """

    row: str
    kept: str
    order = 2

    def __init__(self, keys: Sequence[str], out: Sequence[str]):
        self.keys, self.out = list(keys), list(out)
        fields = [field.split() for field in self.row.split(",")]
        self.columns = [name for name, _ in fields]
        self.packed = np.dtype([(name, {"bigint": "i8", "double": "f8"}[kind]) for name, kind in fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.row)
        self.state = handle.getValueState("kept", self.kept)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """False for a clock tick, which has no value."""
        return ~np.isnan(rows[self.columns[-1]])

    def take(self, kept: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """(state after the row, result row or None)."""
        raise NotImplementedError

    def finish(self, kept: tuple, watermark: int) -> tuple | None:
        """A last result, if the state ends at this watermark."""
        return None

    def wake(self, kept: tuple) -> int | None:
        """The time at which ``finish`` has to be asked."""
        return None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [self._pack(frame) for frame in rows]
        yield from self._advance(key, [part[self.counts(part)] for part in fresh], timerValues)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues)

    def _pack(self, frame: pd.DataFrame) -> np.ndarray:
        """Rows as an array of a few bytes each; a null value is NaN."""
        rows = np.empty(len(frame), self.packed)
        for name in self.columns:
            rows[name] = frame[name].to_numpy(self.packed[name])
        return rows

    def _unpack(self, rows: np.ndarray) -> Iterator[list[tuple]]:
        for at in range(0, len(rows), _SLICE):
            yield [r if r[-1] == r[-1] else (*r[:-1], None) for r in rows[at : at + _SLICE].tolist()]

    def _stored(self) -> list[np.ndarray]:
        rows, parts = iter(self.buffer.get()), []
        while part := [tuple(row) for row in islice(rows, _SLICE)]:
            parts.append(np.array(part, self.packed))
        return parts

    def _results(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.out)
        for name, value in zip(self.keys, key, strict=True):
            frame.insert(0, name, value)
        return frame

    def _advance(self, key: Any, fresh: list[np.ndarray], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = np.concatenate([*self._stored(), *fresh, np.empty(0, self.packed)])
        at = waiting[self.columns[0]]
        due, later = waiting[at <= watermark], waiting[at > watermark]
        del waiting, at
        due = due[np.lexsort([due[name] for name in reversed(self.columns[: self.order])])]
        before = kept = tuple(self.state.get()) if self.state.exists() else None
        results = []
        for part in self._unpack(due):
            for row in part:
                kept, result = self.take(kept, row)
                results += [result] if result else []
            if len(results) >= _SLICE:
                yield self._results(key, results)
                results = []
        if len(due):
            self.buffer.clear()
        for part in self._unpack(later) if len(due) else (p for rows in fresh for p in self._unpack(rows)):
            self.buffer.appendList(part)
        if kept and not len(later) and (last := self.finish(kept, watermark)):
            results.append(last)
            kept = None
        if kept != before:
            self.state.update(kept) if kept else self.state.clear()
        times = [int(later[self.columns[0]].min())] if len(later) else []
        if kept and (end := self.wake(kept)) is not None:
            times.append(end)
        if times:
            # a timer fires once the watermark has reached it
            self.handle.registerTimer(max(min(times) // 1000 + 1, watermark // 1000 + 1))
        if results:
            yield self._results(key, results)


class ChangePoints(InOrder):
    """A key's first point and every point that differs from the one before."""

    row = "at_us bigint, line_no bigint, value double"
    kept = "value double"

    def take(self, kept, row):
        changed = kept is None or kept[0] != row[2]
        return (row[2],), row if changed else None


class Steps(InOrder):
    """Steps from change point to change point, closed after a silence."""

    row = "at_us bigint, line_no bigint, value double"
    kept = "since bigint, line_no bigint, value double, last bigint"

    def __init__(self, keys: Sequence[str], out: Sequence[str], silence: int):
        super().__init__(keys, out)
        self.silence = silence

    def take(self, kept, row):
        at, line, value = row
        if kept is None:
            return (at, line, value, at), None
        since, first, held, last = kept
        if at - last > self.silence:
            return (at, line, value, at), (since, first, held, last)
        if held != value:
            return (at, line, value, at), (since, first, held, at)
        return (since, first, held, at), None

    def wake(self, kept):
        return kept[3] + self.silence

    def finish(self, kept, watermark):
        since, first, held, last = kept
        return (since, first, held, last) if watermark >= last + self.silence else None


class AsOf(InOrder):
    """Probes answered with the last point not after them."""

    row = "at_us bigint, is_probe bigint, tie bigint, value double"
    kept = "value double"
    order = 3

    def counts(self, rows):
        return (rows["is_probe"] == 1) | super().counts(rows)

    def take(self, kept, row):
        at, is_probe, tie, value = row
        if is_probe:
            return kept, (tie, at, kept[0] if kept else None)
        return (value,), None


def _number(name: str) -> Column:
    """A whole number; ticks may lack it."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))


def _typed(points: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Points as (keys, time, line_no, value) under the watermark, ticks included."""
    rows = points.select(
        *keys, _since("ts").alias("at_us"), _number("line_no").alias("line_no"),
        F.col("value").cast("double").alias("value"),
    )
    return _watermarked(rows.filter("at_us IS NOT NULL"), delay)


def _key_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in reversed(keys))


def _run(rows: DataFrame, keys: Sequence[str], processor: InOrder, out: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{_key_schema(rows, keys)}, {out}",
        outputMode="Append",
        timeMode="EventTime",
    )


def follow_change_points(
    points: DataFrame, keys: Sequence[str] = ("query_signal",), delay: str = "10 seconds"
) -> DataFrame:
    """``change_points`` of a stream of (keys, ts, line_no, value); keys are never null."""
    processor = ChangePoints(keys, ["at_us", "line_no", "value"])
    found = _run(_typed(points, keys, delay), keys, processor, "at_us bigint, line_no bigint, value double")
    return found.select(*keys, _time("at_us").alias("ts"), "line_no", "value")


def follow_steps(
    points: DataFrame, keys: Sequence[str] = ("query_signal",), delay: str = "10 seconds", silence: float = 3600
) -> DataFrame:
    """``step_intervals`` of a stream; a silence of more than so many seconds ends a step at its last sample.

    In batch these are the steps by (keys, session), with sessions of
    ``sessions.with_sessions`` that break after such a silence.
    """
    processor = Steps(keys, ["at_us", "line_no", "value", "until_us"], round(silence * 1_000_000))
    found = _run(
        _typed(points, keys, delay), keys, processor, "at_us bigint, line_no bigint, value double, until_us bigint"
    )
    return found.select(
        *keys, _time("at_us").alias("ts"), "line_no", "value", _time("until_us").alias("until")
    )


def follow_asof(
    points: DataFrame, probes: DataFrame, key: str = "query_signal", delay: str = "10 seconds"
) -> DataFrame:
    """``asof_signal_value`` of two streams: probes (probe_id, key, ts) wait until no earlier point can come.

    Each input has its own watermark and the slower one counts, so points that
    lag behind the probes are not late.  After a restart the watermark moves on
    once both inputs have delivered a row, of which a tick is enough.
    """
    none = F.lit(None).cast("double")
    left = points.select(
        key, _since("ts").alias("at_us"), F.lit(0).cast("bigint").alias("is_probe"),
        _number("line_no").alias("tie"), F.col("value").cast("double").alias("value"),
    )
    right = probes.select(
        key, _since("ts").alias("at_us"), F.lit(1).cast("bigint").alias("is_probe"),
        _number("probe_id").alias("tie"), none.alias("value"),
    )
    both = _watermarked(left.filter("at_us IS NOT NULL"), delay).union(_watermarked(right.filter("at_us IS NOT NULL"), delay))
    found = _run(both, [key], AsOf([key], ["probe_id", "at_us", "value"]), "probe_id bigint, at_us bigint, value double")
    return found.select("probe_id", key, _time("at_us").alias("ts"), "value")


def follow_sessions(
    points: DataFrame, keys: Sequence[str] = ("query_signal",), delay: str = "10 seconds", gap: int = 1
) -> DataFrame:
    """``sessions`` of a stream, each emitted when the watermark has passed its end; ``gap`` in whole seconds."""
    rows = _watermarked(points.select(*keys, _since("ts").alias("at_us")).filter("at_us IS NOT NULL"), delay)
    window = F.session_window(_EVENT, f"{gap} seconds")
    found = rows.groupBy(*keys, window).agg(
        F.min("at_us").alias("from_us"), F.max("at_us").alias("to_us"), F.count("*").alias("samples")
    )
    return found.select(*keys, _time("from_us").alias("ts"), _time("to_us").alias("until"), "samples")


def append_table(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append results to a Parquet folder; a restart from ``checkpoint`` goes on where the last run ended."""
    spark: SparkSession = rows.sparkSession
    spark.conf.set(_PROVIDER, ROCKS_DB)
    writer = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
