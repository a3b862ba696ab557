"""Catalogue sheet exported as CSV, read by column position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from busweave import constants as K

POSITIONS = {
    "message_name": K.SHEET_MESSAGE_NAME,
    "component": K.SHEET_COMPONENT,
    "service_id": K.SHEET_SERVICE_ID,
    "method_id": K.SHEET_METHOD_ID,
    "message_type": K.SHEET_MESSAGE_TYPE,
    "signal_name": K.SHEET_SIGNAL_NAME,
}


def read_catalogue_rows(
    spark: SparkSession, path: str, row_no_position: int, sheet: str = "Main"
) -> DataFrame:
    """``(sheet, row_no, message_name, component, ..)``; the header is skipped.

    The export carries a row number, since a cell may hold line breaks and the
    rows of a sheet depend on their order.
    """
    cells = spark.read.csv(
        path, header=True, multiLine=True, escape='"', inferSchema=False
    )
    names = cells.columns
    picked = [F.col(f"`{names[at]}`").alias(name) for name, at in POSITIONS.items()]
    row_no = F.col(f"`{names[row_no_position]}`").try_cast("bigint").alias("row_no")
    return cells.select(F.lit(sheet).alias("sheet"), row_no, *picked)
