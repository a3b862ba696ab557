"""Bit-level decoding of one frame payload.

Everything works on a compact hexadecimal text of the payload, so that a signal
is a substring, a base conversion and a second substring: no per-byte loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from busweave import constants as K
from busweave.functions.text import WS, collapse_blanks, strip

_REGULAR = r"^[0-9a-f]{2}( [0-9a-f]{2})*\z"
NUMBER_BITS = 64
_DIGITS = 8


def payload_bytes(payload: Column) -> Column:
    """Byte texts of a payload; an empty payload has none."""
    return F.filter(F.split(payload, rf"{WS}+"), lambda token: token != "")


def frame(payload: Column) -> Column:
    """``struct(id, size, hex)`` of a payload.

    ``hex`` has two characters per byte; a token that is no byte is held as
    ``..`` so that only signals touching it are refused.
    """
    # Extracted payloads are regular already; only others pay for clean-up.
    regular = payload.rlike(_REGULAR)
    tokens = payload_bytes(F.lower(collapse_blanks(payload)))
    patched = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.rlike("^[0-9a-f]{1,2}$"), F.lpad(t, 2, "0")).otherwise(
                F.lit("..")
            ),
        ),
        "",
    )
    compact = F.when(regular, F.replace(payload, F.lit(" "), F.lit(""))).otherwise(patched)
    first_two = F.concat(F.get(tokens, 0), F.get(tokens, 1))
    frame_id = F.when(
        regular,
        F.when(
            F.length(payload) >= 5, F.concat(F.left(payload, F.lit(2)), F.substring(payload, 4, 2))
        ),
    ).otherwise(first_two)
    return F.struct(
        F.upper(frame_id).alias("id"),
        (F.length(compact) / 2).cast("int").alias("size"),
        compact.alias("hex"),
    )


def frame_id(payload: Column) -> Column:
    """First two bytes, upper case; null when there are fewer."""
    return frame(payload)["id"]


def definition_id(msgid: Column) -> Column:
    return F.upper(F.replace(F.coalesce(msgid, F.lit("")), F.lit(" "), F.lit("")))


def status_byte(frm: Column) -> Column:
    """Text of the third byte, or null."""
    return F.when(frm["size"] >= 3, F.substring(frm["hex"], 5, 2))


def status_ok(frm: Column) -> Column:
    return F.coalesce(status_byte(frm) == "01", F.lit(False))


@dataclass(frozen=True)
class BitField:
    """Where a signal sits; missing parts take the format's defaults.

    The start bit is the field's most significant one, which runs on into bit 7
    of the next byte.  Where ``little`` holds it is the least significant one,
    and the field runs up into bit 0 of the next byte.
    """

    start_byte: Column
    start_bit: Column
    length: Column
    little: Column | None = None

    @classmethod
    def of(
        cls, start_byte: Column, start_bit: Column, length: Column, little: Column | None = None
    ) -> "BitField":
        return cls(
            F.coalesce(start_byte.cast("int"), F.lit(0)),
            F.coalesce(start_bit.cast("int"), F.lit(0)),
            F.coalesce(length.cast("int"), F.lit(1)),
            None if little is None else F.coalesce(little, F.lit(False)),
        )

    @property
    def first(self) -> Column:
        return self.start_byte + K.FRAME_HEADER_BYTES

    @property
    def byte_count(self) -> Column:
        above = 7 - self.start_bit
        if self.little is not None:
            above = F.when(self.little, self.start_bit).otherwise(above)
        return F.greatest(F.floor((above + self.length + 7) / 8).cast("int"), F.lit(0))

    def text(self, frm: Column) -> Column:
        """Hexadecimal text of the bytes the field touches."""
        return F.substring(frm["hex"], self.first * 2 + 1, self.byte_count * 2)


def skip_reason(frm: Column, msgid: Column, field: BitField) -> Column:
    """First failing check in decoding order, or ``ok``."""
    return (
        F.when(frm["size"] < 2, "short_id")
        .when(frm["id"] != definition_id(msgid), "id_mismatch")
        .when(frm["size"] < 3, "short_status")
        .when(status_byte(frm) == "..", "bad_byte")
        .when(status_byte(frm) != "01", "status_not_ok")
        .when(field.first >= frm["size"], "short_start")
        .when(field.length < 1, "bad_length")
        .when(field.first + field.byte_count > frm["size"], "short_bits")
        .when(field.text(frm).contains("."), "bad_byte")
        .otherwise("ok")
    )


def signal_bits(frm: Column, field: BitField) -> Column:
    """Bits of the field, most significant first.

    Call it on rows whose :func:`skip_reason` is ``ok``.  Two conversions serve
    nine bytes; a longer field is converted eight digits at a time.  A start bit
    above 7 lies before the byte and reads as zeros.
    """
    touched = field.text(frm)
    if field.little is not None:
        pairs = F.regexp_extract_all(touched, F.lit("(..)"), F.lit(1))
        touched = F.when(field.little, F.array_join(F.reverse(pairs), "")).otherwise(touched)
    head, tail = F.left(touched, F.lit(_DIGITS)), F.substring(touched, _DIGITS + 1, 10)
    as_bits = lambda h: F.when(
        F.length(h) > 0, F.lpad(F.conv(h, 16, 2), F.length(h) * 4, F.lit("0"))
    ).otherwise(F.lit(""))
    parts = F.regexp_extract_all(touched, F.lit("(.{1,8})"), F.lit(1))
    bits = F.when(
        F.length(touched) <= _DIGITS + 10, F.concat(as_bits(head), as_bits(tail))
    ).otherwise(F.array_join(F.transform(parts, as_bits), ""))
    before = F.greatest(field.start_bit - 7, F.lit(0))
    padded = F.concat(F.repeat(F.lit("0"), before), bits)
    straight = F.substring(padded, F.greatest(8 - field.start_bit, F.lit(1)), field.length)
    if field.little is None:
        return straight
    turned = F.substring(bits, 8 * field.byte_count - field.start_bit - field.length + 1, field.length)
    return F.when(field.little, turned).otherwise(straight)


def bits_to_number(bits: Column) -> Column:
    """Unsigned value of up to 64 bits; null above, where the bits still stand."""
    digits = F.regexp_replace(bits, "^0+(?=.)", "")
    return F.when(
        F.length(digits) <= NUMBER_BITS, F.conv(digits, 2, 10).cast("decimal(20,0)")
    )


def bits_to_digits(bits: Column) -> Column:
    """Unsigned value of any number of bits as decimal text.

    Up to 64 bits one conversion serves.  Longer values are carried as limbs of
    nine digits, to which the bits are added 29 at a time.
    """
    div = lambda a, b: F.call_function("div", a, b)
    limb_of = F.lit(1_000_000_000).cast("bigint")

    def add(limbs: Column, part: Column) -> Column:
        times = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(part))
        start = F.struct(
            F.array().cast("array<bigint>").alias("out"), F.conv(part, 2, 10).cast("bigint").alias("carry")
        )
        moved = F.aggregate(
            limbs, start,
            lambda done, limb: F.struct(
                F.concat(done["out"], F.array((limb * times + done["carry"]) % limb_of)).alias("out"),
                div(limb * times + done["carry"], limb_of).alias("carry"),
            ),
            lambda done: F.concat(done["out"], F.array(done["carry"])),
        )
        return moved

    parts = F.regexp_extract_all(bits, F.lit("(.{1,29})"), F.lit(1))
    limbs = F.aggregate(parts, F.array().cast("array<bigint>"), add)
    text = F.array_join(F.transform(F.reverse(limbs), lambda n: F.lpad(n.cast("string"), 9, "0")), "")
    return F.when(F.length(bits) <= NUMBER_BITS, bits_to_number(bits).cast("string")).otherwise(
        F.regexp_replace(text, "^0+(?=.)", "")
    )


def bits_to_double(bits: Column) -> Column:
    """Unsigned value of any number of bits, to double precision."""
    parts = F.regexp_extract_all(bits, F.lit("(.{1,32})"), F.lit(1))
    return F.aggregate(
        parts,
        F.lit(0.0),
        lambda total, p: total * F.pow(F.lit(2.0), F.length(p)) + F.conv(p, 2, 10).cast("double"),
    )


def _negative(bits: Column, signed: Column) -> Column:
    return signed & bits.startswith("1")


def _opposite(bits: Column) -> Column:
    """Bits of ``-1 - value`` of a negative value."""
    return F.translate(bits, "01", "10")


def signed_number(bits: Column, signed: Column) -> Column:
    """Two's complement where ``signed`` holds; null if the value itself takes more than 64 bits."""
    number = lambda b: bits_to_number(b).cast("decimal(21,0)")
    value = F.when(_negative(bits, signed), -1 - number(_opposite(bits))).otherwise(number(bits))
    return value.cast("decimal(21,0)")


def signed_double(bits: Column, signed: Column) -> Column:
    """Value of any number of bits to double precision, as two's complement where ``signed`` holds."""
    wide = F.when(_negative(bits, signed), -1.0 - bits_to_double(_opposite(bits))).otherwise(bits_to_double(bits))
    return F.when(F.length(bits) <= NUMBER_BITS, signed_number(bits, signed).cast("double")).otherwise(wide)


def choice_label(choices: Column, raw: Column) -> Column:
    return choices[raw.cast("string")]


def has_choices(choices: Column) -> Column:
    return F.coalesce(F.size(choices) > 0, F.lit(False))


def scale_physical(raw: Column, factor: Column, offset: Column) -> Column:
    return raw.cast("double") * F.coalesce(factor, F.lit(1.0)) + F.coalesce(
        offset, F.lit(0.0)
    )


def in_range(value: Column, minimum: Column, maximum: Column) -> Column:
    """Inclusive; a missing limit counts as zero."""
    return value.between(
        F.coalesce(minimum, F.lit(0.0)), F.coalesce(maximum, F.lit(0.0))
    )


def match_status(
    choices: Column, raw: Column, physical: Column, minimum: Column, maximum: Column
) -> Column:
    labelled = choice_label(choices, raw).isNotNull()
    return (
        F.when(has_choices(choices) & labelled, "matched")
        .when(has_choices(choices), "no_match")
        .when(in_range(physical, minimum, maximum), "valid")
        .otherwise("out_of_range")
    )


def frame_id_text(number: Column) -> Column:
    """At least four upper-case hexadecimal digits; longer ids stay whole."""
    digits = F.hex(number.cast("bigint"))
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def start_byte_of(start: Column) -> Column:
    return F.floor(start / 8).cast("int")


def start_bit_of(start: Column) -> Column:
    return F.pmod(start, F.lit(8)).cast("int")


def choice_map(choices: Column) -> Column:
    """Choice labels stripped; no choices at all becomes the empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.transform_values(choices, lambda _, v: strip(v)), empty)


def sorted_choice_keys(choices: Column) -> Column:
    """Numeric keys in order; keys that are no number are left out."""
    numbers = F.transform(F.map_keys(choices), lambda k: k.try_cast("bigint"))
    return F.array_sort(F.filter(numbers, lambda k: k.isNotNull()))


def choice_index(keys: Column, value: Column) -> Column:
    """Zero-based place of a value among sorted keys; absent counts as zero."""
    place = F.coalesce(F.array_position(keys, value.try_cast("bigint")), F.lit(0))
    return F.greatest(place - 1, F.lit(0)).cast("bigint")


def unit_position(value: Column, minimum: Column, maximum: Column) -> Column:
    """Place of a value between its limits, clamped to 0..1; 0 for an empty span."""
    share = (value - minimum) / F.nullif(maximum - minimum, F.lit(0.0))
    return F.when(
        maximum > minimum, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    ).otherwise(F.lit(0.0))
