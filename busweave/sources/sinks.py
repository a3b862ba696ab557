"""Writers.  All of them write in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_jsonl_split(samples: DataFrame, path: str) -> None:
    """One JSON object per line below ``split=<name>`` folders."""
    samples.select("split", "text").write.partitionBy("split").json(path)


def write_text_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(column).write.text(path)


def time_ordered(df: DataFrame, time: str = "time", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows in time order across tasks.

    ``ties`` joins the range key, so that a time shared by very many rows is
    still spread over several tasks.
    """
    keys = (time, *ties)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_time_ordered(
    df: DataFrame, path: str, time: str = "time", ties: tuple[str, ...] = ()
) -> None:
    time_ordered(df, time, ties).write.json(path)


def write_line_table(lines: DataFrame, path: str) -> None:
    """Timed lines as Parquet in the order they are read.

    Logs run in time order, so the row groups of a file cover short spans and a
    pushed time filter skips most of them.
    """
    lines.write.parquet(path)


def write_message_table(messages: DataFrame, path: str) -> None:
    """Messages as Parquet by log day, sorted by ids within each task.

    Later analyses read only the days of their window (partition pruning), the
    row groups of their ids (pushed filters) and the columns they need, instead
    of parsing text again.  Tasks write where they read: a block of a log covers
    few days, so nothing is shuffled and the text is parsed exactly once.
    """
    by_day = messages.withColumn("day", F.left("time", F.lit(5)))
    by_day.sortWithinPartitions("day", "service_id", "method_id", "time").write.partitionBy(
        "day"
    ).parquet(path)
