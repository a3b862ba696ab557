"""Lines to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from busweave import constants as K
from busweave.functions import text as X
from busweave.operators.computed import with_computed


def filter_message_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter(X.is_message_line(F.col(column)))


def _holds(marker: str) -> Column:
    """The patterns ignore case, unlike the prefilter."""
    return F.lower("value").contains(marker.lower())


def _other_columns(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c != "value"]


def _with_groups(lines: DataFrame, name: str, joined: Column) -> DataFrame:
    """Add the pattern groups of each line; the pattern runs once per line."""
    text = f"{name}_text"
    return lines.withColumn(text, joined).withColumn(
        name, X.groups_of(F.col(text), F.col("value"))
    )


def _received(lines: DataFrame) -> DataFrame:
    return _with_groups(lines, "_rx", F.when(_holds(K.RX_MARKER), X.rx_joined(F.col("value"))))


def _sent(lines: DataFrame, untried: Column | None = None) -> DataFrame:
    wanted = _holds(K.TX_MARKER) if untried is None else untried & _holds(K.TX_MARKER)
    return _with_groups(lines, "_tx", F.when(wanted, X.tx_joined(F.col("value"))))


def _both(lines: DataFrame) -> DataFrame:
    """Groups as received, else as sent.

    The costly patterns run only on lines that hold a marker text, tested by a
    plain substring search.
    """
    return _sent(_received(lines), F.col("_rx").isNull())


def extract_rx_messages(lines: DataFrame) -> DataFrame:
    """Received messages only; all other columns of the lines are kept."""
    groups = F.col("_rx")
    return with_computed(
        _received(lines), X.rx_message(groups), groups.isNotNull(), _other_columns(lines)
    )


def extract_tx_messages(lines: DataFrame) -> DataFrame:
    groups = F.col("_tx")
    return with_computed(
        _sent(lines), X.tx_message(groups), groups.isNotNull(), _other_columns(lines)
    )


def _either(rx: Column, tx: Column) -> dict[str, Column]:
    """Message fields from whichever groups are there."""
    received, sent = X.rx_message(rx), X.tx_message(tx)
    return {
        name: F.when(rx.isNotNull(), received[name]).otherwise(sent[name])
        for name in X.MESSAGE_FIELDS
    }


def with_message(lines: DataFrame, name: str = "message") -> DataFrame:
    """Every line with its message struct, null for other lines."""
    rx, tx = F.col("_rx"), F.col("_tx")
    fields = F.struct(*[c.alias(n) for n, c in _either(rx, tx).items()])
    found = rx.isNotNull() | tx.isNotNull()
    return with_computed(
        _both(lines), {name: F.when(found, fields)}, keep=lines.columns
    )


def extract_messages(lines: DataFrame) -> DataFrame:
    """Five fields per message line; other lines are dropped."""
    rx, tx = F.col("_rx"), F.col("_tx")
    return with_computed(
        _both(lines),
        _either(rx, tx),
        rx.isNotNull() | tx.isNotNull(),
        _other_columns(lines),
    )
