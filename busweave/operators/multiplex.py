"""Decoding with byte order, sign and multiplexed signals.

Definitions hold, beside the plain fields, ``little_endian``, ``is_signed``,
``is_multiplexor`` and ``mux_value`` (all may be null: big-endian, unsigned, always
present).  A frame is decoded in two stages: its multiplexor's value first, then
the signals that are always present and those of that value.  Both stages are
equi-joins, so signals of other values never meet the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busweave.functions import frames as B
from busweave.operators.computed import with_computed
from busweave.operators.decoding import with_frame
from busweave.operators.lookup import first_match_per_key


def _field() -> B.BitField:
    return B.BitField.of(F.col("start_byte"), F.col("start_bit"), F.col("length"), F.col("little_endian"))


def _signed() -> Column:
    return F.coalesce(F.col("is_signed"), F.lit(False))


def _with_bits(pairs: DataFrame) -> DataFrame:
    """Rows whose signal can be read, with its bits."""
    reason = B.skip_reason(F.col("_frame"), F.col("msgid"), _field())
    return with_computed(pairs, {"_bits": F.when(reason == "ok", B.signal_bits(F.col("_frame"), _field()))}).filter(
        "_bits IS NOT NULL"
    )


def selectors(definitions: DataFrame) -> DataFrame:
    """One multiplexor per frame id, the first by ``query_signal``."""
    chosen = definitions.filter("is_multiplexor").select(
        B.definition_id(F.col("msgid")).alias("_frame_id"), "msgid", "query_signal", "start_byte", "start_bit",
        "length", "little_endian", "is_signed",
    )
    return first_match_per_key(chosen, ["_frame_id"], "query_signal")


def with_selector(framed: DataFrame, definitions: DataFrame) -> DataFrame:
    """Frames with ``_selector``, the value of their multiplexor; null without one."""
    names = ["msgid", "query_signal", "start_byte", "start_bit", "length", "little_endian", "is_signed"]
    joined = framed.join(selectors(definitions), "_frame_id", "left")
    ok = B.skip_reason(F.col("_frame"), F.col("msgid"), _field()) == "ok"
    bits = with_computed(joined, {"_mux": F.when(F.col("msgid").isNotNull() & ok, B.signal_bits(F.col("_frame"), _field()))})
    value = B.signed_number(F.col("_mux"), _signed()).cast("bigint")
    return bits.withColumn("_selector", value).drop("_mux", *names)


def decode_fields(messages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Messages with each signal that their frame holds.

    Adds the definition's columns, ``decoded_bits``, ``number`` (up to 64 bits,
    signed), ``physical_value`` (any length, scaled) and ``match_label``.
    """
    parts = definitions.withColumns(
        {"_frame_id": B.definition_id(F.col("msgid")), "_mux_value": F.col("mux_value").cast("bigint")}
    )
    framed = with_selector(with_frame(messages), definitions)
    # a frame asks for the signals without a value, and for those of its own value
    asked = F.when(F.col("_selector").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.array(F.lit(None).cast("bigint"), F.col("_selector"))
    )
    frames = framed.withColumn("_asked", F.explode(asked)).withColumnRenamed("_frame_id", "_id")
    pairs = frames.join(
        parts, (F.col("_id") == F.col("_frame_id")) & F.col("_asked").eqNullSafe(F.col("_mux_value"))
    )
    bits = F.col("_bits")
    numbered = _with_bits(pairs).withColumns(
        {"number": B.signed_number(bits, _signed()), "_double": B.signed_double(bits, _signed())}
    )
    label = F.when(B.has_choices(F.col("choices")), B.choice_label(F.col("choices"), F.col("number")))
    return numbered.withColumns(
        {
            "decoded_bits": bits,
            "physical_value": B.scale_physical(F.col("_double"), F.col("factor"), F.col("offset")),
            "match_label": label,
        }
    ).drop("_bits", "_double", "_frame", "_frame_id", "_id", "_asked", "_selector", "_mux_value")
