"""Messy catalogue sheet cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from busweave import constants as K
from busweave.functions.text import strip, without_nbsp


def clean_cell(raw: Column) -> Column:
    return strip(without_nbsp(raw.cast("string")))


def clean_message_name(raw: Column) -> Column:
    """Drop non-breaking blanks, strip, then drop the frame prefix in any case."""
    return F.regexp_replace(clean_cell(raw), rf"^(?i){K.CAN_FRAME_PREFIX}", "")


def normalise_msg_type(raw: Column) -> Column:
    """Lower-case text; plain digits become hexadecimal text; null becomes ''."""
    cell = F.lower(clean_cell(raw))
    digits = F.regexp_replace(cell, "^0+(?=.)", "")
    as_hex = F.concat(F.lit("0x"), F.lower(F.conv(digits, 10, 16)))
    return F.when(raw.isNull(), F.lit("")).when(
        cell.rlike(r"^0*\d{1,19}$"), as_hex
    ).otherwise(cell)


def message_direction(raw: Column, lenient: bool = False) -> Column:
    """Direction of a message type cell.

    Only the two-digit texts count; ``lenient`` also accepts equal numbers.
    """
    kind = normalise_msg_type(raw)
    tx, rx = (["0x01"], ["0x02"])
    if lenient:
        tx, rx = (["0x01", "0x1"], ["0x02", "0x2"])
    return (
        F.when(kind.isin(tx), "tx").when(kind.isin(rx), "rx").otherwise("unknown")
    )


def decimal_id(raw: Column) -> Column:
    """Integer of an id cell held as text: decimal or ``0x`` digits, else null."""
    cell = F.lower(clean_cell(raw))
    digits = F.regexp_replace(cell, "(?<=[0-9a-fx])_(?=[0-9a-f])", "")
    hex_digits = F.regexp_replace(digits, "^0x0*(?=.)", "")
    return F.when(
        digits.rlike(r"^0x[0-9a-f]+$"),
        F.when(F.length(hex_digits) <= 16, F.conv(hex_digits, 16, 10).try_cast("bigint")),
    ).when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))


def decimal_id_of_number(raw: Column) -> Column:
    """Integer of an id cell held as a number: the fraction is cut off."""
    return raw.try_cast("bigint")


def is_can_component(raw: Column) -> Column:
    return F.coalesce(clean_cell(raw) == K.CAN_COMPONENT, F.lit(False))


def expand_signal_cell(raw: Column) -> Column:
    """Signal names of a cell: one per line, ``x[3]`` gives ``x[0] x[1] x[2]``.

    A count that is no int leaves the name as it stands.
    """
    lines = F.filter(
        F.transform(F.split(clean_cell(raw), r"[\r\n]+"), clean_cell), lambda s: s != ""
    )
    # Fixed value: a name with a count in brackets.
    sized = r"^(.+?)\[(\d+)\]$"

    def members(name: Column) -> Column:
        base = strip(F.regexp_extract(name, sized, 1))
        count = F.regexp_extract(name, sized, 2).try_cast("int")
        numbered = F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
            lambda i: F.concat(base, F.lit("["), i.cast("string"), F.lit("]")),
        )
        none = F.array().cast("array<string>")
        return (
            F.when(~name.rlike(sized) | count.isNull(), F.array(name))
            .when(count > 0, numbered)
            .otherwise(none)
        )

    return F.flatten(F.transform(lines, members))
