"""Requested properties to decoded values around one target time, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from busweave import constants as K
from busweave.functions.frames import definition_id
from busweave.operators.decoding import decode_frames, decode_requests, with_frame
from busweave.operators.matching import (
    lookup_catalogue_message,
    match_messages,
    parse_properties,
    route_definitions,
)
from busweave.operators.messages import extract_messages
from busweave.operators.windowing import filter_time_window, window_with_continuations
from busweave.session import settle


@dataclass(frozen=True)
class Analysis:
    """Results of an analysis: lazy frames over settled requests and definitions."""

    matches: DataFrame
    definitions: DataFrame
    decoded: DataFrame
    rejected: DataFrame


def window_messages(
    lines: DataFrame,
    target: Column,
    seconds: float = K.WINDOW_SECONDS,
    strict: bool = False,
    file: str = "file_path",
    key: str = "line_key",
) -> DataFrame:
    """Messages around a target time.

    ``strict`` applies the scan rule of :func:`window_with_continuations`, which
    stops a file at the first line past the window.  Lines without a time carry
    no message either way.
    """
    if strict:
        inside = window_with_continuations(lines, target, seconds, file, key)
    else:
        inside = filter_time_window(lines, target, seconds)
    return extract_messages(inside)


def analyze_properties(
    properties: DataFrame,
    messages: DataFrame,
    catalogue: DataFrame,
    noncan: DataFrame,
    dictionary: DataFrame,
) -> Analysis:
    """Look up, match and decode every property of a table.

    ``messages`` are the messages of the wanted window, with a ``line_no``.  The
    request side, a handful of small joins, is settled; the messages are joined
    to it once, whatever the number of properties.
    """
    parsed = parse_properties(properties)
    looked_up = settle(lookup_catalogue_message(parsed, catalogue), "requests")
    definitions = settle(route_definitions(looked_up, noncan, dictionary), "definitions")
    return Analysis(
        matches=match_messages(looked_up, messages),
        definitions=definitions,
        decoded=decode_requests(looked_up, messages, definitions),
        rejected=parsed.filter(F.col("error").isNotNull()),
    )


def nested_matches(matches: DataFrame) -> DataFrame:
    """Match rows as nested records; ``test_result`` is null without a message."""
    ids = ("service_id", "method_id")
    return matches.select(
        "query_signal",
        F.struct("message_name", "is_can", *ids, "direction").alias("catalogue_message"),
        F.when(
            F.col("matched"),
            F.struct("time", F.lower("direction").alias("type"), *ids, "payload"),
        ).alias("test_result"),
    )


def analyze_log(
    lines: DataFrame,
    target: Column,
    seconds: float,
    file: str,
    key: str,
    properties: DataFrame,
    catalogue: DataFrame,
    noncan: DataFrame,
    dictionary: DataFrame,
) -> Analysis:
    """Slice a text log by the scan rule, then analyse it.

    The messages of the slice are settled, since matching reads them twice; a
    log that is analysed often should be kept as a message table instead.
    """
    window = window_messages(lines, target, seconds, strict=True, file=file, key=key)
    return analyze_properties(
        properties, settle(window, "window"), catalogue, noncan, dictionary
    )


def decode_messages(messages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Decode messages directly by frame id, without a property request.

    One pass over the messages; definitions join on the frame id.
    """
    parts = definitions.withColumn("_frame_id", definition_id(F.col("msgid")))
    pairs = with_frame(messages).join(parts, "_frame_id")
    return decode_frames(pairs).drop("_frame", "_frame_id")
