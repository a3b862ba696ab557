"""Two tables compared as multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def reconcile(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that one table holds more often, with ``side``, ``surplus`` and both counts.

    Rows count +1 on the left and -1 on the right, summed per distinct row in one
    shuffle.  Copies are added up inside each task first, so a row that makes up
    a third of a table moves as one row per task.  Nulls equal each other, as in
    ``EXCEPT ALL``; the surplus on either side is what ``EXCEPT ALL`` would
    return that way round.
    """
    names = list(columns or left.columns)
    signed = left.select(*names, F.lit(1).alias("_sign")).unionByName(right.select(*names, F.lit(-1).alias("_sign")))
    balance = signed.groupBy(*names).agg(
        F.sum("_sign").alias("_balance"),
        F.count_if(F.col("_sign") > 0).alias("left_rows"),
        F.count_if(F.col("_sign") < 0).alias("right_rows"),
    )
    return balance.filter("_balance <> 0").select(
        *names,
        F.when(F.col("_balance") > 0, "left").otherwise("right").alias("side"),
        F.abs("_balance").alias("surplus"),
        "left_rows",
        "right_rows",
    )


def reconciliation_counts(differences: DataFrame) -> DataFrame:
    """One row: distinct rows and copies in surplus on either side."""
    return differences.agg(
        *[
            F.coalesce(how(F.when(F.col("side") == side, column)), F.lit(0)).alias(f"{side}_{name}")
            for side in ("left", "right")
            for name, how, column in (("distinct", F.count, F.lit(1)), ("surplus", F.sum, F.col("surplus")))
        ]
    )
