"""Signal dictionary: from bus messages, to names, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busweave.functions import frames as B
from busweave.functions.text import signal_property
from busweave.operators.lookup import (
    first_match_per_key,
    last_match_per_key,
    left_join_large_right,
    merged,
)
from busweave.schemas import DEFINITION_FIELDS


def union_directions(messages: DataFrame, numbered: bool = False) -> DataFrame:
    """(direction, node) rows: sent by each sender, received by each receiver.

    Both directions come out of one pass over the messages.  ``numbered`` adds
    ``node_no``, the place of the node in its list.
    """
    tagged = lambda column, tag: F.transform(
        F.coalesce(F.col(column), F.array().cast("array<string>")),
        lambda node, i: F.struct(
            F.lit(tag).alias("direction"), node.alias("node"), i.alias("node_no")
        ),
    )
    roles = F.concat(tagged("senders", "tx"), tagged("receivers", "rx"))
    kept = [c for c in messages.columns if c not in ("senders", "receivers")]
    return messages.select(F.explode(roles).alias("_role"), *kept).select(
        "_role.direction", "_role.node", *(["_role.node_no"] if numbered else []), *kept
    )


def distinct_nodes(messages: DataFrame) -> DataFrame:
    return union_directions(messages).select("node").distinct()


def build_signal_dictionary(messages: DataFrame, signals: DataFrame) -> DataFrame:
    """Flat dictionary rows of bus messages, ready for lookups and for nesting.

    A name that a node holds twice keeps its last message only, whole.  A
    message without signals keeps one row with a null signal.  ``place`` is the
    order a converted file would have: nodes by their first message, then
    messages, then signals.  Limits and scaling come from ``signals`` if it has
    them.
    """
    numbers = ("minimum", "maximum", "offset", "factor")
    number = lambda c: (F.col(c) if c in signals.columns else F.lit(None)).cast("double").alias(c)
    roles = last_match_per_key(
        union_directions(messages, numbered=True), ["direction", "node", "name"], "message_no"
    )
    start = F.col("start")
    seen = F.struct(F.col("message_no").cast("bigint").alias("message"), F.col("node_no").alias("node"))
    first = roles.groupBy("direction", "node").agg(F.min(seen).alias("_first"))
    roles = roles.join(first, ["direction", "node"])
    order = F.col("signal_no") if "signal_no" in signals.columns else F.col("start")
    return left_join_large_right(roles, signals, "message_no").select(
        "direction",
        F.col("node").alias("namespace"),
        F.col("name").alias("message"),
        "signal",
        B.frame_id_text(F.col("frame_id")).alias("msgid"),
        B.start_byte_of(start).alias("start_byte"),
        B.start_bit_of(start).alias("start_bit"),
        "length",
        B.choice_map(F.col("choices")).alias("choices"),
        *[number(c) for c in numbers],
        F.struct(
            F.lit("").alias("file"),
            F.col("_first").alias("namespace"),
            F.col("message_no").cast("bigint").alias("message"),
            order.cast("bigint").alias("signal"),
        ).alias("place"),
    )


def nest_message_signals(flat: DataFrame) -> DataFrame:
    """Export form: one row per (direction, namespace, message), signals as a map.

    A map holds the signals of one frame, which its bit length bounds; of two
    signals of one name the last stays.
    """
    if "place" in flat.columns:
        names = ["direction", "namespace", "message", "signal"]
        flat = last_match_per_key(flat, names, "place")
    fields = [c for c in flat.columns if c in DEFINITION_FIELDS]
    entry = F.when(
        F.col("signal").isNotNull(), F.struct("signal", F.struct(*fields))
    )
    return flat.groupBy("direction", "namespace", "message").agg(
        F.map_from_entries(F.collect_list(entry)).alias("signals")
    )


def format_signal_names(flat: DataFrame) -> DataFrame:
    """``<message>__<signal>_<direction>_v`` of every row; duplicates stay."""
    place = ["place"] if "place" in flat.columns else []
    return flat.filter(F.col("signal").isNotNull()).select(
        "direction", "namespace", "message", "signal", *place,
        signal_property(F.col("message"), F.col("signal"), F.col("direction")).alias("name"),
    )


def signal_count(names: DataFrame) -> DataFrame:
    return names.agg(F.count("*").alias("signals"))


def search_signal_names(
    names: DataFrame, query: str, limit: int, order: str = "line_key"
) -> DataFrame:
    """First ``limit`` names holding the query, any case; blank finds nothing."""
    wanted = query.strip().lower()
    if not wanted:
        return names.limit(0)
    hits = names.filter(F.lower("name").contains(wanted))
    return hits.orderBy(order).limit(limit)


def lookup_signal_definition(requests: DataFrame, flat: DataFrame) -> DataFrame:
    """Left-join requests(asked_direction, message, signal) to their definition.

    Message and signal ignore case, the direction does not.  Of several
    namespaces the first that holds the signal wins.
    """
    entries = flat.filter(F.col("signal").isNotNull()).select(
        F.col("direction").alias("asked_direction"),
        F.lower("message").alias("_message"),
        F.lower("signal").alias("_signal"),
        "place",
        "namespace",
        F.col("message").alias("def_message"),
        F.col("signal").alias("def_signal"),
        *DEFINITION_FIELDS,
    )
    keys = ["asked_direction", "_message", "_signal"]
    first = first_match_per_key(entries, keys, "place").drop("place")
    keyed = requests.withColumns(
        {"_message": F.lower("message"), "_signal": F.lower("signal")}
    )
    return keyed.join(merged(first), keys, "left").drop("_message", "_signal")
