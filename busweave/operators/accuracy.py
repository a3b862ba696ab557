"""Extracted messages against the exact ones, on three levels.

Times carry no year and repeat from log to log.  ``scope`` names columns of both
tables, such as the log's path, within which messages are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from busweave.functions.text import normalize_payload
from busweave.operators.lookup import last_match_per_key

IDENTITY = ("time", "type", "service_id", "method_id")
LEVELS = ("exact", "payload", "identity", "missing")


def _timed(found: DataFrame) -> DataFrame:
    return found.filter(F.coalesce("time", F.lit("")) != "").withColumns(
        {
            "type": F.lower(F.coalesce("type", F.lit(""))),
            "payload": normalize_payload(F.coalesce("payload", F.lit(""))),
        }
    )


def _latest(found: DataFrame, order: str, scope: Sequence[str]) -> DataFrame:
    """Last row per identity; rows without an id cannot match."""
    usable = _timed(found).filter(
        F.col("service_id").isNotNull() & F.col("method_id").isNotNull()
    )
    identity = (*scope, *IDENTITY)
    rows = usable.select(*identity, order, F.col("payload").alias("found_payload"))
    return last_match_per_key(rows, identity, order).drop(order)


def _times(found: DataFrame, scope: Sequence[str]) -> DataFrame:
    return _timed(found).select(*scope, "time").distinct()


def accuracy_exact(
    truth: DataFrame, found: DataFrame, order: str = "place", scope: Sequence[str] = ()
) -> DataFrame:
    """Truth rows with ``level`` exact or payload; null without an identity match."""
    joined = truth.join(_latest(found, order, scope), [*scope, *IDENTITY], "left")
    same = F.col("found_payload") == F.col("payload")
    return joined.withColumn("level", F.when(same, "exact").when(~same, "payload"))


def accuracy_levels(
    truth: DataFrame, found: DataFrame, order: str = "place", scope: Sequence[str] = ()
) -> DataFrame:
    """Every truth row with its level."""
    seen = _times(found, scope).withColumn("_seen", F.lit(True))
    return (
        accuracy_exact(truth, found, order, scope)
        .join(seen, [*scope, "time"], "left")
        .withColumn(
            "level",
            F.coalesce("level", F.when(F.col("_seen"), "identity").otherwise("missing")),
        )
        .drop("_seen")
    )


def accuracy_identity_mismatch(
    truth: DataFrame, found: DataFrame, order: str = "place", scope: Sequence[str] = ()
) -> DataFrame:
    """Truth rows without an identity match whose time was found."""
    return truth.join(_latest(found, order, scope), [*scope, *IDENTITY], "left_anti").join(
        _times(found, scope), [*scope, "time"], "left_semi"
    )


def accuracy_missing(
    truth: DataFrame, found: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Truth rows whose time was not found at all."""
    return truth.join(_times(found, scope), [*scope, "time"], "left_anti")


def accuracy_mismatch_detail(
    truth: DataFrame, found: DataFrame, order: str = "place", scope: Sequence[str] = ()
) -> DataFrame:
    """What was found at the time of each mismatched truth row, field by field.

    Equal rows are counted before pairing (``truth_rows``, ``found_rows``), so
    copies at one time do not multiply.
    """
    fields = ("time", "type", "service_id", "method_id", "payload")
    wrong = (
        accuracy_identity_mismatch(truth, found, order, scope)
        .groupBy(*scope, *fields)
        .agg(F.count("*").alias("truth_rows"))
    )
    got = (
        _timed(found)
        .groupBy(*scope, *fields)
        .agg(F.count("*").alias("found_rows"))
        .select(*scope, "time", "found_rows", *[F.col(c).alias(f"found_{c}") for c in fields[1:]])
    )
    paired = wrong.join(got, [*scope, "time"])
    return paired.withColumns(
        {
            f"{c}_ok": F.coalesce(F.col(c) == F.col(f"found_{c}"), F.lit(False))
            for c in fields[1:]
        }
    )


def accuracy_report(
    truth: DataFrame, found: DataFrame, order: str = "place", scope: Sequence[str] = ()
) -> DataFrame:
    """Counts per level and the share of exact rows in percent, 0 when empty."""
    counts = accuracy_levels(truth, found, order, scope).agg(
        F.count("*").alias("truth_rows"),
        *[F.count_if(F.col("level") == name).alias(f"{name}_rows") for name in LEVELS],
    )
    share = F.col("exact_rows") / F.nullif(F.col("truth_rows"), F.lit(0)) * 100
    return counts.withColumn("accuracy", F.coalesce(share, F.lit(0.0)))
