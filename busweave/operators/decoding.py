"""Matched frames to decoded signal values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busweave.functions import frames as B
from busweave.operators.computed import with_computed
from busweave.operators.lookup import merged
from busweave.operators.matching import MESSAGE_COLUMNS, matched_messages, unmatched_requests
from busweave.schemas import DEFINITION_FIELDS

_NAMES = ("namespace", "def_message", "def_signal")
# The note texts of rows without a value.
NOTE_NO_MESSAGE = "test_result is None, skipping"
NOTE_NO_PAYLOAD = "payload is empty, skipping"


def with_frame(messages: DataFrame) -> DataFrame:
    """Add the frame struct and its id as a join column."""
    framed = with_computed(messages, {"_frame": B.frame(F.col("payload"))})
    return framed.withColumn("_frame_id", F.col("_frame.id"))


def decode_frames(pairs: DataFrame, keep_skipped: bool = False) -> DataFrame:
    """Decode rows that hold a frame and a definition.

    Adds ``status``, ``decoded_bits``, ``signal_value`` (up to 64 bits),
    ``signal_digits`` (any length, as text), ``physical_value``,
    ``match_value``, ``match_label`` and ``match_status``.  Rows that cannot be
    decoded are dropped, or kept with their status.
    """
    frm, bits, raw, digits = F.col("_frame"), F.col("_bits"), F.col("_raw"), F.col("_digits")
    field = B.BitField.of(F.col("start_byte"), F.col("start_bit"), F.col("length"))
    ok, choices = F.col("_reason") == "ok", F.col("choices")

    checked = pairs.withColumn("_reason", B.skip_reason(frm, F.col("msgid"), field))
    sliced = checked.withColumn("_bits", F.when(ok, B.signal_bits(frm, field)))
    valued = sliced.withColumns({"_raw": B.bits_to_number(bits), "_digits": B.bits_to_digits(bits)}).withColumn(
        "_physical",
        F.when(
            ~B.has_choices(choices),
            B.scale_physical(
                F.when(F.length(bits) <= B.NUMBER_BITS, raw.cast("double")).otherwise(
                    B.bits_to_double(bits)
                ),
                F.col("factor"), F.col("offset"),
            ),
        ),
    )
    physical = F.col("_physical")
    label = F.when(B.has_choices(choices), B.choice_label(choices, digits))
    status = B.match_status(choices, digits, physical, F.col("minimum"), F.col("maximum"))
    return with_computed(
        valued,
        {
            "status": F.col("_reason"),
            "decoded_bits": bits,
            "signal_value": raw,
            "signal_digits": digits,
            "physical_value": physical,
            "match_value": F.when(label.isNotNull(), digits.cast("double")).otherwise(physical),
            "match_label": label,
            "match_status": F.when(ok, status),
        },
        where=None if keep_skipped else ok,
        keep=pairs.columns,
    )


def _definition_parts(definitions: DataFrame) -> DataFrame:
    """One row per requested property and frame id."""
    return definitions.filter(F.col("msgid").isNotNull()).select(
        "query_signal",
        B.definition_id(F.col("msgid")).alias("_frame_id"),
        *[c for c in _NAMES if c in definitions.columns],
        *DEFINITION_FIELDS,
    ).dropDuplicates(["query_signal", "_frame_id"])


def decode_requests(
    looked_up: DataFrame,
    messages: DataFrame,
    definitions: DataFrame,
    keep_skipped: bool = False,
) -> DataFrame:
    """As :func:`decode_join` after matching, with one join of the messages.

    Requests get their definitions first, on the small side; messages then join
    them by service, method, direction and frame id at once, so that no message
    is copied to a request that another frame serves.  ``looked_up`` and
    ``definitions`` are read several times: settle them.
    """
    payload = F.col("payload")
    empty = payload.isNull() | (payload == "")
    can = looked_up.filter(F.coalesce("is_can", F.lit(False)))
    parts = can.join(merged(_definition_parts(definitions)), "query_signal").withColumnRenamed(
        "_frame_id", "_asked_id"
    )
    framed = with_frame(messages.filter(~empty))
    pairs = matched_messages(
        parts, framed, (*MESSAGE_COLUMNS, "_frame", "_frame_id"),
        F.col("_frame_id") == F.col("_asked_id"),
    ).withColumn("note", F.lit(None).cast("string"))
    decoded = decode_frames(pairs, keep_skipped).drop("_frame", "_frame_id", "_asked_id")
    unread = matched_messages(can, messages.filter(empty)).withColumn("note", F.lit(NOTE_NO_PAYLOAD))
    missing = unmatched_requests(can, messages).withColumn("note", F.lit(NOTE_NO_MESSAGE))
    notes = unread.unionByName(missing)
    return decoded.unionByName(notes, allowMissingColumns=True)


def decode_join(
    matched: DataFrame, definitions: DataFrame, keep_skipped: bool = False
) -> DataFrame:
    """Decode each matched CAN message with the definitions of its request.

    The join is an equi-join on request and frame id.  A request without a
    message, or a message without a payload, gives one row with a ``note``.  A
    property that is requested several times is decoded once per request: the
    matches hold each request, so its definitions count once.
    Frames are computed here unless :func:`with_frame` ran on the messages
    before, which is cheaper when several requests share a message.
    """
    can = matched.filter(F.coalesce("is_can", F.lit(False)))
    payload = F.col("payload")
    empty = payload.isNull() | (payload == "")
    note = F.when(~F.col("matched"), NOTE_NO_MESSAGE).when(empty, NOTE_NO_PAYLOAD)
    parts = _definition_parts(definitions)
    framed = can.filter(F.col("matched") & ~empty).withColumn(
        "note", F.lit(None).cast("string")
    )
    if "_frame" not in matched.columns:
        framed = with_frame(framed)
    pairs = framed.join(parts, ["query_signal", "_frame_id"])
    decoded = decode_frames(pairs, keep_skipped).drop("_frame", "_frame_id")
    notes = can.withColumn("note", note).filter(~F.col("matched") | empty)
    notes = notes.drop("_frame", "_frame_id")
    return decoded.unionByName(notes, allowMissingColumns=True)
