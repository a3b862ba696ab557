"""Rows with long texts held against small tables of keys, without shuffling the texts.

The keys are settled and counted.  Up to ``MOST_KEYS`` they are broadcast as they
are; above, each key becomes one of ``MOST_KEYS`` slots and the slots are
broadcast, so the broadcast never exceeds that many long values.  Rows of other
slots are decided at once, and only rows of the taken slots are shuffled for the
exact join.  The more keys there are beyond the bound, the more rows that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Long values broadcast at most: about 50 MB as a hash table.
MOST_KEYS = 1 << 20


def _held(keys: DataFrame, key: str, most: int) -> tuple[DataFrame, bool]:
    """Distinct keys, or slots if there are too many."""
    distinct = keys.select(F.col(key).cast("long").alias("__held")).distinct()
    if distinct.count() <= most:
        return F.broadcast(distinct), True
    return F.broadcast(distinct.select(F.pmod("__held", F.lit(most)).alias("__held")).distinct()), False


def possible(rows: DataFrame, hashed: Column, keys: DataFrame, key: str, most: int = MOST_KEYS) -> DataFrame:
    """Rows whose long ``hashed`` is, or shares a slot with, a key; all others have none."""
    held, exact = _held(keys, key, most)
    place = hashed if exact else F.pmod(hashed, F.lit(most))
    return rows.join(held, place == F.col("__held"), "left_semi")


def without(
    rows: DataFrame, hashed: Column, keys: DataFrame, key: str, same: Column, most: int = MOST_KEYS
) -> DataFrame:
    """Rows that match no row of ``keys`` by the condition ``same``, which implies ``hashed`` = key."""
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), same, "left_anti")
    held, _ = _held(keys, key, most)
    place = F.pmod(hashed, F.lit(most))
    clear = rows.join(held, place == F.col("__held"), "left_anti")
    return clear.unionByName(possible(rows, hashed, keys, key, most).join(keys, same, "left_anti"))
