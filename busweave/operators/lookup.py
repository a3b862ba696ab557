"""First and last match per key, as hash aggregates with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def merged(df: DataFrame) -> DataFrame:
    """A join side that Spark must not broadcast by the size of the file it comes from.

    Files of few bytes can hold millions of rows, and exploded rows count as one.
    Once planned, such a broadcast stays, whatever a later stage measures.
    """
    return df.hint("merge")


def left_join_large_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join whose right side may hold a hot key.

    An outer join cannot split a hot key on its right side, nor broadcast its
    left.  Hits are therefore an inner join, which can do both; left rows
    without a partner are found against the distinct keys.
    """
    hits = left.join(right, key)
    misses = left.join(right.select(key).distinct(), key, "left_anti")
    return hits.unionByName(misses, allowMissingColumns=True)


def _pick(df: DataFrame, keys: Sequence[str], order: str, picker) -> DataFrame:
    """A task sorts its rows before it combines them, so rows are dealt out first: a
    scan task may hold any number of them, a shuffled one only a partition's."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.repartition(*keys, order)
        .groupBy(*keys)
        .agg(picker(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def first_match_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key."""
    return _pick(df, keys, order, F.min_by)


def last_match_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    return _pick(df, keys, order, F.max_by)
