"""Columns that are evaluated once.

Spark pushes a filter on a computed column below the projection and repeats the
expression there; with several layers the copies multiply.  A generator that
yields exactly one row is not crossed by filters on its own output, while
filters on all other columns still pass it on their way to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_computed(
    df: DataFrame,
    columns: dict[str, Column],
    where: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add (or replace) columns; rows where ``where`` is not true are dropped."""
    kept = df.columns if keep is None else keep
    row = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    if where is not None:
        row = F.when(where, row)
    return df.select(*[c for c in kept if c not in columns], F.inline(row))
