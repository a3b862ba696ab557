"""Years for logs whose lines carry none.

Within a file, lines are in writing order.  A line more than ``slack`` days (and
one for a leap day between them, which the year may lack) before the one above it
opens the next year; a line that leaps ahead by a whole year less that slack is a
straggler from before New Year and belongs to the year before.  The year of a
line is the file's first year plus the turns up to it: a prefix sum over the
file's order, cut into chunks so that one long file spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busweave.operators.ordered import running_sum, with_neighbours
from busweave.operators.windowing import micros

#: A year in which every date exists; parse lines with it (``log_timestamp``).
LEAP_ANCHOR = 2000
_DAY = 86_400_000_000


def in_year(ts: Column, year: Column) -> Column:
    """The same month, day and time in another year; null for a leap day that it lacks."""
    return F.try_make_timestamp_ntz(
        year.cast("int"), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts), F.date_part(F.lit("SECOND"), ts)
    )


def with_years(
    lines: DataFrame,
    start_year: int,
    file: str = "file_path",
    key: str = "line_key",
    slack_days: float = 1,
    chunk: Column | None = None,
) -> DataFrame:
    """Lines with ``year`` and with ``ts`` in that year.

    ``ts`` comes in under ``LEAP_ANCHOR``; ``start_year`` is the year of each
    file's first timed line.  ``chunk`` may name parts of the file order, never
    falling in ``key``; without it the lines are spread by range.  Lines without
    a time keep none and have no year.
    """
    slack = round(slack_days * _DAY)
    timed = lines.filter(F.col("ts").isNotNull())
    seen = with_neighbours(timed, [file], [key], ["ts"], chunk=chunk)
    ahead = micros("ts") - micros(F.col("_previous.ts"))
    turn = F.when(ahead < -slack - _DAY, 1).when(ahead > 366 * _DAY - slack, -1).otherwise(0)
    turned = seen.withColumn("_turn", turn).drop("_previous", "_following")
    summed = running_sum(turned, [file], [key], "_turn", "_turns", chunk=chunk)
    year = F.lit(start_year) + F.col("_turns")
    dated = summed.withColumn("year", year.cast("int")).withColumn("ts", in_year(F.col("ts"), F.col("year")))
    untimed = lines.filter(F.col("ts").isNull()).withColumn("year", F.lit(None).cast("int"))
    return dated.drop("_turn", "_turns").unionByName(untimed)
