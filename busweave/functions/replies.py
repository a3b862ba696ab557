"""Prompts for a line scorer and the replies that come back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from busweave import constants as K
from busweave.functions.text import strip

DEFAULT_INSTRUCTION = (
    "Read one vehicle log line. If it is a received or sent service message, answer "
    "with a JSON object holding time, type (rx or tx), serviceId, methodId and payload; "
    "ids of received messages are hexadecimal in the line and decimal in the answer. "
    'For any other line answer exactly {"type": "ignore"}'
)
# The keys under which a reply may hold its time.
TIME_KEYS = ("time", "timestamp", "Time", "Timestamp")


def build_prompt(line: Column, instruction: str = DEFAULT_INSTRUCTION) -> Column:
    return F.concat(
        F.lit(f"{K.INSTRUCTION_HEADER}\n{instruction}\n\n{K.INPUT_HEADER}\n"),
        line,
        F.lit(f"\n\n{K.RESPONSE_HEADER}\n"),
    )


def token_budget(line_length: Column) -> Column:
    return F.greatest(
        F.lit(K.MIN_BUDGET),
        F.least(line_length - K.BUDGET_OFFSET, F.lit(K.MAX_BUDGET)),
    ).cast("int")


def clean_response(text: Column) -> Column:
    """Drop an opening fence, a second one, then a closing one; strip last."""
    opened = F.regexp_replace(text, r"^(?:```json)?(?:```)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def parse_response(text: Column) -> Column:
    """Reply as VARIANT; null when it is no JSON."""
    return F.try_parse_json(text)


def is_object(reply: Column) -> Column:
    return F.coalesce(F.schema_of_variant(reply).startswith("OBJECT"), F.lit(False))


def text_field(reply: Column, key: str) -> Column:
    """A field only if it is JSON text."""
    return F.when(
        F.schema_of_variant(_part(reply, key)) == "STRING",
        F.try_variant_get(reply, f"$.{key}", "string"),
    )


def integer_field(reply: Column, key: str) -> Column:
    """A field only if it is a JSON integer; text digits do not count."""
    return F.when(
        F.schema_of_variant(_part(reply, key)) == "BIGINT",
        F.try_variant_get(reply, f"$.{key}", "bigint"),
    )


def _part(reply: Column, key: str) -> Column:
    return F.try_variant_get(reply, f"$.{key}", "variant")


def reply_class(reply: Column) -> Column:
    """``parsed``, ``ignored`` or ``error`` by the exact type text."""
    kind = text_field(reply, "type")
    return F.when(~is_object(reply), "error").when(
        kind == K.IGNORE_TYPE, "ignored"
    ).when(kind.isin("rx", "tx"), "parsed").otherwise("error")


def reply_time(reply: Column) -> Column:
    """First time key that is present, even if its value is a JSON null."""
    first = F.lit("")
    for key in reversed(TIME_KEYS):
        first = F.when(
            _part(reply, key).isNotNull(), F.try_variant_get(reply, f"$.{key}", "string")
        ).otherwise(first)
    return first


def json_text(value: Column) -> Column:
    """A quoted and escaped JSON text."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, 6, F.length(wrapped) - 6)


def message_answer(message: Column, indent: str = "  ") -> Column:
    """Expected answer of a line, indented: five fields or the not-a-message mark."""
    lead = f"\n{indent}"
    fields = F.concat(
        F.lit(f'{{{lead}"time": '), json_text(message["time"]),
        F.lit(f',{lead}"type": '), json_text(message["type"]),
        F.lit(f',{lead}"serviceId": '), message["service_id"].cast("string"),
        F.lit(f',{lead}"methodId": '), message["method_id"].cast("string"),
        F.lit(f',{lead}"payload": '), json_text(message["payload"]),
        F.lit("\n}"),
    )
    other = F.lit(f'{{{lead}"error": "{K.NOT_A_MESSAGE}"\n}}')
    return F.when(message["type"].isNotNull(), fields).otherwise(other)


def training_text(
    line: Column, answer: Column, instruction: str = DEFAULT_INSTRUCTION
) -> Column:
    return F.concat(build_prompt(line, instruction), answer)
