"""Ranks within keys over range-sorted partitions, without a task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from busweave.session import settle


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, label: str = "ranked") -> DataFrame:
    """Add ``name``: zero-based rank of each row by ``order`` within ``keys``.

    Rows are range-sorted once and written; a row's rank is its place in its
    partition plus the rows of its key in earlier partitions, a table of one row
    per partition and key border.
    """
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = settle(spread.withColumn("__row", F.monotonically_increasing_id()), label)
    part = F.shiftright("__row", 33)
    per = rows.groupBy(*keys, part.alias("__part")).agg(
        F.min("__row").alias("__low"), F.count("*").alias("__n")
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low")
    offsets = per.select(
        *[F.col(k).alias("_" + k) for k in keys], F.col("__part").alias("__p"), shift.alias("__shift")
    )
    offsets = settle(offsets, label + "-offsets")
    same = part == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    return (
        rows.join(offsets, same)
        .withColumn(name, F.col("__row") + F.col("__shift"))
        .drop("__row", "__p", "__shift", *["_" + k for k in keys])
    )
