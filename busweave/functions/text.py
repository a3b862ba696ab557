"""Log-line text: timestamps, message fields, property and signal names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from busweave import constants as K

# Every character a text strip would remove, not only the ASCII blank.
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NBSP = "\u00a0"

# --- fixed values: patterns of line times and message lines ---
_LINE_TIME = rf"^{WS}*(\d\d-\d\d{WS}+\d\d:\d\d:\d\d\.\d{{1,6}})(?!\d)"
_TARGET_TIME = r"^\d\d?-\d\d? \d\d?:\d\d?:\d\d?(\.\d{1,6})?$"

# (?id): ignore case, and only \n ends a line.  The lazy head finds the first
# place where the whole pattern fits, as a search would.
_TIME = r"(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)"
_RX_LINE = (
    rf"(?id)^.*?{_TIME}.*?SomeipCOmm :: RX Message"
    rf".*?service:([0-9a-f]+){WS}*,Method:([0-9a-f]+),payload:(.*)$"
)
_TX_LINE = (
    rf"(?id)^.*?{_TIME}.*?TX Message SomeipComm::send"
    rf".*?service:(\d+),method:(\d+),{WS}*response Payload:{WS}*(.*)$"
)
_SEP = "\u0001"
_JOINED_GROUPS = _SEP.join(("$1", "$2", "$3", "$4"))

MESSAGE_FIELDS = ("time", "type", "service_id", "method_id", "payload")


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def without_nbsp(text: Column) -> Column:
    return F.replace(text, F.lit(NBSP), F.lit(""))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def normalize_payload(raw: Column) -> Column:
    """Lower case, stripped, one blank between bytes."""
    return collapse_blanks(F.lower(raw))


def is_message_line(line: Column) -> Column:
    """Cheap prefilter: either fixed marker, exact case."""
    return line.contains(K.RX_MARKER) | line.contains(K.TX_MARKER)


def _with_year(month_day_time: Column, year: int) -> Column:
    return F.concat(F.lit(f"{year:04d}-"), month_day_time).try_cast("timestamp_ntz")


def log_timestamp(line: Column, anchor_year: int = 1900) -> Column:
    """Leading ``MM-DD HH:MM:SS.f`` of a line, or null.

    The fraction is required and has one to six digits.  Lines carry no year,
    so a leap day parses only under a leap ``anchor_year``.
    """
    found = collapse_blanks(F.regexp_extract(line, _LINE_TIME, 1))
    return _with_year(F.nullif(found, F.lit("")), anchor_year)


def target_timestamp(text: Column, anchor_year: int = 1900) -> Column:
    """A user-supplied time; its fraction is optional."""
    clean = collapse_blanks(text)
    padded = F.regexp_replace(clean, r"(?<!\d)(?<!\.)(\d)(?!\d)", "0$1")
    return F.when(
        clean.rlike(_TARGET_TIME), _with_year(padded, anchor_year)
    )


def _id_from_hex(digits: Column) -> Column:
    # conv() takes 64 bits; values beyond a bigint give null.
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(
        F.length(significant) <= 16, F.conv(significant, 16, 10).try_cast("bigint")
    )


def rx_joined(line: Column) -> Column:
    """Groups of a received message joined by a separator, or the line unchanged.

    Service and method are hexadecimal in the text.  One pattern pass yields all
    groups.  A fitting line loses its literal parts and so never comes back
    unchanged.
    """
    return F.regexp_replace(line, _RX_LINE, _JOINED_GROUPS)


def tx_joined(line: Column) -> Column:
    """As :func:`rx_joined` for a sent message, whose ids are decimal."""
    return F.regexp_replace(line, _TX_LINE, _JOINED_GROUPS)


def groups_of(joined: Column, line: Column) -> Column:
    """The four groups, or null when the line did not fit."""
    return F.when(joined != line, F.split(joined, _SEP, 4))


def rx_message(groups: Column) -> dict[str, Column]:
    """Message fields of received groups."""
    return {
        "time": groups[0],
        "type": F.lit("rx"),
        "service_id": _id_from_hex(groups[1]),
        "method_id": _id_from_hex(groups[2]),
        "payload": normalize_payload(groups[3]),
    }


def tx_message(groups: Column) -> dict[str, Column]:
    """Message fields of sent groups."""
    return {
        "time": groups[0],
        "type": F.lit("tx"),
        "service_id": groups[1].try_cast("bigint"),
        "method_id": groups[2].try_cast("bigint"),
        "payload": normalize_payload(groups[3]),
    }


def message_property(name: Column) -> Column:
    """Message of a ``VHAL_`` property, '' when the name has another form."""
    return F.regexp_extract(name, K.MESSAGE_PROPERTY, 1)


def signal_property_joined(name: Column) -> Column:
    """Message, signal and direction of a signal property, joined in one pass.

    A fitting name loses its fixed parts, so only others come back unchanged.
    """
    return F.regexp_replace(name, K.SIGNAL_PROPERTY, _SEP.join(("$1", "$2", "$3")))


def signal_property_groups(joined: Column, name: Column) -> Column:
    return F.when(joined != name, F.split(joined, _SEP, 3))


def signal_property(message: Column, signal: Column, direction: Column) -> Column:
    return F.concat(message, F.lit("__"), signal, F.lit("_"), direction, F.lit("_v"))


def signal_owner(name: Column) -> Column:
    """Text before the first ``__``; empty when there is none."""
    at = F.instr(name, "__")
    return F.when(at > 0, F.left(name, at - 1)).otherwise(F.lit(""))


def signal_label(name: Column) -> Column:
    """Text after the first ``__``; the whole name when there is none."""
    at = F.instr(name, "__")
    return F.when(at > 0, F.substring(name, at + 2, F.length(name))).otherwise(name)
