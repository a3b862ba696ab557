"""Message catalogue and signal lists from sheet rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from busweave.functions import cells as S
from busweave.operators.ordered import carry_forward


def _id_column(rows: DataFrame, name: str):
    numeric = isinstance(rows.schema[name].dataType, NumericType)
    return (S.decimal_id_of_number if numeric else S.decimal_id)(F.col(name))


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "_name", F.coalesce(S.clean_message_name(F.col("message_name")), F.lit(""))
    )


def build_catalogue(rows: DataFrame, lenient_types: bool = False) -> DataFrame:
    """Catalogue messages of sheet rows; rows without a name are skipped."""
    return _cleaned(rows).filter(F.col("_name") != "").select(
        "sheet",
        "row_no",
        F.col("_name").alias("message_name"),
        S.is_can_component(F.col("component")).alias("is_can"),
        _id_column(rows, "service_id").alias("service_id"),
        _id_column(rows, "method_id").alias("method_id"),
        S.message_direction(F.col("message_type"), lenient_types).alias("direction"),
    )


def catalogue_counts(rows: DataFrame) -> DataFrame:
    """Parsed and skipped rows, and messages left out of the signal lists."""
    named = F.col("_name") != ""
    return _cleaned(rows).agg(
        F.count_if(named).alias("parsed"),
        F.count_if(~named).alias("skipped"),
        F.count_if(named & S.is_can_component(F.col("component"))).alias("skipped_can"),
    )


def fill_message_rows(rows: DataFrame) -> DataFrame:
    """Attach every row to the last message row above it in its sheet.

    Adds ``group_no`` (row number of that message row), ``group_name`` (cleaned,
    '' for a blank one) and ``group_is_can``; null above the first message row.
    Two messages of one name stay two groups.
    """
    opens = F.when(
        F.col("message_name").isNotNull(),
        F.struct(
            F.col("row_no").alias("group_no"),
            S.clean_message_name(F.col("message_name")).alias("group_name"),
            S.is_can_component(F.col("component")).alias("group_is_can"),
        ),
    )
    filled = carry_forward(
        rows.withColumn("_opens", opens), ["sheet"], ["row_no"], "_opens", "_group_row"
    )
    return filled.select(*rows.columns, "_group_row.*")


def exclude_can_messages(filled: DataFrame) -> DataFrame:
    """Drop CAN messages together with their continuation rows.

    Works on filled rows: a blank or CAN message row swallows the rows below it.
    """
    return filled.filter((F.col("group_name") != "") & ~F.col("group_is_can"))


def message_signals(rows: DataFrame) -> DataFrame:
    """One row per signal of each non-CAN message, in sheet order.

    (row_no, cell_pos) orders the signals of a message.  A message without
    signals keeps one row with a null signal.
    """
    kept = exclude_can_messages(fill_message_rows(rows))
    expanded = kept.select(
        "sheet",
        "group_no",
        F.col("group_name").alias("message_name"),
        "row_no",
        F.posexplode_outer(S.expand_signal_cell(F.col("signal_name"))).alias(
            "cell_pos", "signal"
        ),
    )
    opens_group = F.col("row_no") == F.col("group_no")
    return expanded.filter(F.col("signal").isNotNull() | opens_group)


def signals_per_message(rows: DataFrame) -> DataFrame:
    """Export form: one row per message with its ordered signal list.

    A list is one sheet entry, so it is as long as the sheet author made it; use
    :func:`message_signals` wherever lists need not be whole values.
    """
    found = F.when(
        F.col("signal").isNotNull(), F.struct("row_no", "cell_pos", "signal")
    )
    return (
        message_signals(rows)
        .groupBy("sheet", "group_no", "message_name")
        .agg(F.array_sort(F.collect_list(found)).alias("_signals"))
        .select("sheet", "group_no", "message_name", F.col("_signals.signal").alias("signals"))
    )
