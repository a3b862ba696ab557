"""Log slices around target times."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from busweave import constants as K

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
# Fixed value: parts that the lines of each file are dealt into for a join by file.
_FILE_PARTS = 64


def _interval(seconds: float) -> Column:
    return F.make_dt_interval(secs=F.lit(Decimal(str(seconds))))


def _tick(ts: Column) -> Column:
    """Whole seconds since a fixed date; never falls as time rises."""
    origin = F.expr("timestamp_ntz'1600-01-01 00:00:00'")
    return F.timestamp_diff("SECOND", origin, ts)


def micros(ts: Column | str) -> Column:
    """Microseconds of a time without zone since 1970, whatever the session's zone."""
    at = F.col(ts) if isinstance(ts, str) else ts
    minutes = F.unix_date(F.to_date(at)).cast("bigint") * 1440 + F.hour(at) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def from_micros(column: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {column}, {_EPOCH})")


def time_chunk(ts: Column | str, seconds: int = 600) -> Column:
    """Number of the time slot of a row, for the ``chunk`` of order-dependent steps."""
    return F.floor(micros(ts) / (seconds * 1_000_000))


def filter_time_window(
    lines: DataFrame, target: Column, seconds: float = K.WINDOW_SECONDS
) -> DataFrame:
    """Lines with ``ts`` within ``seconds`` of one target time, ends included."""
    half = _interval(seconds)
    return lines.filter(F.col("ts").between(target - half, target + half))


def filter_time_windows(
    lines: DataFrame, targets: DataFrame, seconds: float = K.WINDOW_SECONDS
) -> DataFrame:
    """Lines within ``seconds`` of each row of ``targets(target_id, target_ts)``.

    Time is cut into slots as wide as a window.  A window touches two or three
    slots, so the range test becomes an equi-join on the slot plus an exact
    filter; Spark broadcasts the targets if their measured size allows it and
    shuffles by slot otherwise.
    """
    width = F.lit(max(1, int(2 * seconds) + 1)).cast("bigint")
    half = _interval(seconds)
    slot = lambda ts: F.floor(_tick(ts) / width)
    spans = targets.select(
        "target_id",
        (F.col("target_ts") - half).alias("_lo"),
        (F.col("target_ts") + half).alias("_hi"),
    ).filter(F.col("_lo").isNotNull())
    by_slot = spans.withColumn(
        "_slot", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi"))))
    )
    timed = lines.filter(F.col("ts").isNotNull()).withColumn("_slot", slot(F.col("ts")))
    return (
        timed.join(by_slot, "_slot")
        .filter(F.col("ts").between(F.col("_lo"), F.col("_hi")))
        .drop("_slot", "_lo", "_hi")
    )


def window_with_continuations(
    lines: DataFrame,
    target: Column,
    seconds: float = K.WINDOW_SECONDS,
    file: str = "file_path",
    key: str = "line_key",
) -> DataFrame:
    """The window plus lines without a time that follow its first line.

    Per file the slice starts at the first line inside the window and stops at
    the first later line past it.  Both places are one small aggregate per
    file; the lines themselves are only filtered.  A few files may hold the whole
    log, so their lines are dealt out by a hash of the key, and every part gets
    the places of its file.
    """
    half = _interval(seconds)
    low, high = target - half, target + half
    ts, at = F.col("ts"), F.col(key)
    inside = ts.between(low, high)
    dealt = lambda df: df.withColumn("_part", F.pmod(F.hash(key), F.lit(_FILE_PARTS)))
    copied = lambda df: df.withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(_FILE_PARTS - 1)))
    )

    timed = lines.select(file, key, "ts")
    starts = timed.filter(inside).groupBy(file).agg(F.min(key).alias("_start"))
    stops = (
        dealt(timed.filter(ts > high))
        .join(copied(starts), [file, "_part"])
        .filter(at > F.col("_start"))
        .groupBy(file)
        .agg(F.min(key).alias("_stop"))
    )
    bounds = starts.join(stops, file, "left")
    in_slice = (at >= F.col("_start")) & (
        F.col("_stop").isNull() | (at < F.col("_stop"))
    )
    return (
        dealt(lines.filter(inside | ts.isNull()))
        .join(copied(bounds), [file, "_part"])
        .filter(in_slice)
        .drop("_start", "_stop", "_part")
    )
