"""Requested properties against catalogue, signal lists, dictionary and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busweave import constants as K
from busweave.functions import text as X
from busweave.operators.computed import with_computed
from busweave.operators.dictionary import lookup_signal_definition
from busweave.operators.lookup import first_match_per_key, merged
from busweave.schemas import DEFINITION_FIELDS


def parse_properties(names: DataFrame, column: str = "query_signal") -> DataFrame:
    """Requests of property names; names that fit no form keep an ``error``.

    The message form is tested first.
    """
    name, message, groups = F.col(column), F.col("_message"), F.col("_groups")
    staged = names.withColumn("_message", X.message_property(name)).withColumn(
        "_joined", F.when(message == "", X.signal_property_joined(name))
    )
    staged = staged.withColumn("_groups", X.signal_property_groups(F.col("_joined"), name))
    as_message, as_signal = message != "", groups.isNotNull()
    return with_computed(
        staged,
        {
            "kind": F.when(as_message, "message").when(as_signal, "signal"),
            "message": F.when(as_message, message).otherwise(groups[0]),
            "signal": groups[1],
            "asked_direction": F.lower(groups[2]),
            "error": F.when(
                name.isNull() | (~as_message & ~as_signal), "unrecognised property name"
            ),
        },
        keep=names.columns,
    )


def lookup_catalogue_message(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First catalogue row of each request; ``found`` is false for misses.

    Names are compared in lower case without underscores.
    """
    squeeze = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(""))
    known = catalogue.select(
        squeeze(F.col("message_name")).alias("_name"),
        "row_no",
        "message_name", "is_can", "service_id", "method_id", "direction",
        F.lit(True).alias("found"),
    )
    first = first_match_per_key(known, ["_name"], "row_no").drop("row_no")
    return (
        requests.filter(F.col("kind").isNotNull())
        .withColumn("_name", squeeze(F.col("message")))
        .join(merged(first), "_name", "left")
        .drop("_name", "error")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


MESSAGE_COLUMNS = ("line_no", "time", "payload")


def match_messages(
    looked_up: DataFrame,
    messages: DataFrame,
    carried: tuple[str, ...] = MESSAGE_COLUMNS,
) -> DataFrame:
    """All messages with the service, method and direction of each found request.

    A null id matches a null id.  A request without a message keeps one row with
    ``matched`` false.  The large side is never the preserved side of an outer
    join: hits are an inner join, which can broadcast or split a hot id, and
    misses compare the requests with the distinct ids of the messages.
    """
    hits = matched_messages(looked_up, messages, carried)
    return hits.unionByName(unmatched_requests(looked_up, messages, carried))


def _message_ids() -> list[Column]:
    return [
        F.col("service_id").alias("_service"),
        F.col("method_id").alias("_method"),
        F.lower(F.coalesce("type", F.lit(""))).alias("_type"),
    ]


def _wanted(looked_up: DataFrame) -> DataFrame:
    way = F.lower(F.coalesce("direction", F.lit("")))
    return looked_up.filter("found").withColumn("_way", way)


def _same_ids() -> Column:
    return (
        F.col("service_id").eqNullSafe(F.col("_service"))
        & F.col("method_id").eqNullSafe(F.col("_method"))
        & (F.col("_way") == F.col("_type"))
    )


def matched_messages(
    looked_up: DataFrame,
    messages: DataFrame,
    carried: tuple[str, ...] = MESSAGE_COLUMNS,
    also: Column | None = None,
) -> DataFrame:
    """The hits of :func:`match_messages`; ``also`` is a further join condition."""
    same = _same_ids() if also is None else _same_ids() & also
    return (
        messages.select(*_message_ids(), *carried)
        .join(merged(_wanted(looked_up)), same)
        .withColumn("matched", F.lit(True))
        .drop("_service", "_method", "_type", "_way")
    )


def unmatched_requests(
    looked_up: DataFrame,
    messages: DataFrame,
    carried: tuple[str, ...] = MESSAGE_COLUMNS,
) -> DataFrame:
    """The misses of :func:`match_messages`, with nulls for the message."""
    seen = messages.select(*_message_ids()).distinct()
    misses = _wanted(looked_up).join(seen, _same_ids(), "left_anti").drop("_way")
    return misses.withColumns(
        {c: F.lit(None).cast(messages.schema[c].dataType) for c in carried}
    ).withColumn("matched", F.lit(False))


def lookup_noncan_signals(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Signal list of each request's message, lower case compared, underscores kept."""
    known = records.select(
        F.lower("message_name").alias("_name"),
        "row_no",
        F.col("message_name").alias("list_message"),
        "signals",
    )
    first = first_match_per_key(known, ["_name"], "row_no").drop("row_no")
    return (
        requests.withColumn("_name", F.lower("message"))
        .join(merged(first), "_name", "left")
        .drop("_name")
    )


def route_definitions(
    looked_up: DataFrame, noncan: DataFrame, dictionary: DataFrame
) -> DataFrame:
    """One definition result per request: signal list, definition, note or error."""
    both = lookup_signal_definition(lookup_noncan_signals(looked_up, noncan), dictionary)
    found, is_can = F.col("found"), F.coalesce("is_can", F.lit(False))
    by_signal = F.col("kind") == "signal"
    takes_list = found & ~is_can
    takes_definition = found & is_can & by_signal
    hit = F.when(takes_list, F.col("list_message").isNotNull()).when(
        takes_definition, F.col("def_message").isNotNull()
    )
    missing = F.concat(
        F.lit("'"), F.col("message"), F.lit("' not found in the message catalogue")
    )
    only = lambda condition, name: F.when(condition, F.col(name)).alias(name)
    return both.select(
        "query_signal",
        F.when(takes_list & hit, "signals").when(takes_definition & hit, "definition").alias("source"),
        F.when(~found, missing)
        .when(~F.coalesce(hit, F.lit(True)), K.ERROR_NOT_FOUND)
        .alias("error"),
        F.when(found & is_can & ~by_signal, K.NOTE_CAN_NEEDS_SIGNAL).alias("note"),
        F.when(takes_list, F.col("list_message"))
        .when(takes_definition, F.col("def_message"))
        .alias("result_message"),
        only(takes_list, "signals"),
        only(takes_definition, "namespace"),
        only(takes_definition, "def_signal"),
        *[only(takes_definition, name) for name in DEFINITION_FIELDS],
    )
