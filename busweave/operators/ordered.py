"""Order-dependent steps that no single key can turn into one task.

A window partitioned by a key puts every row of that key into one task.  Here
rows are range-partitioned by (keys, order) instead, so a key with a third of
all rows spans many chunks.  A window works inside each (chunk, key), and only
the first and last row of each (chunk, key) meet in a second, small window that
carries values across chunk borders.

A ``chunk`` column that never falls in ``order``, such as a time slot, takes the
place of the range partitions: rows are then shuffled once by (chunk, key), and
what precedes the step does not run a second time for a sample.  A slot should
hold many rows of a busy key, and a key few slots compared with its rows.

``order`` must be unique per key; otherwise tied rows may change places between
the steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busweave.session import settle

_CHUNK, _GROUP, _HEAD, _TAIL = "_chunk", "_group", "_head", "_tail"
_HELPERS = (_CHUNK, _GROUP, _HEAD, _TAIL)
_BORDER = -1
_FIRST_CHUNK = -(1 << 62)


def _chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    if chunk is not None:
        # even numbers, so that none is the border's; nulls sort first
        return df.withColumn(_CHUNK, F.coalesce(chunk.cast("bigint") * 2, F.lit(_FIRST_CHUNK)))
    spread = df.repartitionByRange(*keys, *order)
    return spread.withColumn(_CHUNK, F.spark_partition_id())


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(_CHUNK, *keys).orderBy(*order)


def _borders(keys: Sequence[str], order: Sequence[str]):
    """Border rows of a key share one group; all others stay in their chunk."""
    return Window.partitionBy(_GROUP, *keys).orderBy(*order)


def _with_group(df: DataFrame, border: Column) -> DataFrame:
    return df.withColumn(
        _GROUP, F.when(border, F.lit(_BORDER)).otherwise(F.col(_CHUNK))
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    previous: str = "_previous",
    following: str = "_following",
    keep: Callable[[Column, Column], Column] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Add structs of ``values`` from the row before and after, null at the ends.

    ``keep`` maps the two structs to a filter.  Rows inside a chunk know both
    neighbours after the first window, so the ones it drops are never shuffled
    a second time.
    """
    seen = F.struct(*values)
    before, after = F.col(previous), F.col(following)
    inside, borders = _inside(keys, order), _borders(keys, order)

    local = _chunked(df, keys, order, chunk).withColumns(
        {previous: F.lag(seen).over(inside), following: F.lead(seen).over(inside)}
    )
    # A struct is never null itself, so a null marks the end of a chunk.
    border = before.isNull() | after.isNull()
    if keep is not None:
        local = local.filter(border | keep(before, after))
    across = _with_group(local, border).withColumns(
        {"_from": F.lag(seen).over(borders), "_to": F.lead(seen).over(borders)}
    )
    done = across.withColumns(
        {
            previous: F.coalesce(before, F.col("_from")),
            following: F.coalesce(after, F.col("_to")),
        }
    ).drop("_from", "_to", *_HELPERS)
    return done if keep is None else done.filter(keep(before, after))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    wanted: Column | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to and including each row.

    With ``wanted`` only those rows are returned, and the others leave the plan
    right after the first window.
    """
    border = F.col(_HEAD) | F.col(_TAIL)
    inside = _inside(keys, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = _borders(keys, order).rowsBetween(Window.unboundedPreceding, -1)

    local = _chunked(df, keys, order, chunk).withColumns(
        {
            "_local": F.last(value, ignorenulls=True).over(so_far),
            _HEAD: F.lag(F.lit(True)).over(inside).isNull(),
            _TAIL: F.lead(F.lit(True)).over(inside).isNull(),
        }
    )
    if wanted is not None:
        local = local.filter(border | wanted)
    across = _with_group(local, border).withColumn(
        "_incoming", F.last("_local", ignorenulls=True).over(before)
    )
    handed_on = F.first(F.when(F.col(_HEAD), F.col("_incoming"))).over(so_far)
    done = across.withColumn(name, F.coalesce("_local", handed_on)).drop(
        "_local", "_incoming", *_HELPERS
    )
    return done if wanted is None else done.filter(wanted)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    chunk: Column | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including each row; nulls add nothing."""
    inside = _inside(keys, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = _borders(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)

    local = _chunked(df, keys, order, chunk).withColumns(
        {
            "_local": F.coalesce(F.sum(value).over(so_far), nothing),
            _HEAD: F.lag(F.lit(True)).over(inside).isNull(),
            _TAIL: F.lead(F.lit(True)).over(inside).isNull(),
        }
    )
    across = _with_group(local, F.col(_HEAD) | F.col(_TAIL)).withColumn(
        "_incoming", F.coalesce(F.sum(F.when(F.col(_TAIL), F.col("_local"))).over(before), nothing)
    )
    handed_on = F.first(F.when(F.col(_HEAD), F.col("_incoming"))).over(so_far)
    return across.withColumn(name, F.col("_local") + handed_on).drop("_local", "_incoming", *_HELPERS)


def global_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: zero-based place of each row in the order of the whole table.

    Rows are sorted by range and written once, numbered within their partition;
    one row per partition tells how many come before it.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(spread.withColumn("_row", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_row", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.min("_row").alias("_low"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.col("_part") * 0).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low")
    shifts = counts.select("_part", shift.alias("_shift"))
    return (
        rows.join(F.broadcast(shifts), part == F.col("_part"))  # one row per partition
        .withColumn(name, (F.col("_row") + F.col("_shift")).cast("bigint"))
        .drop("_row", "_part", "_shift")
    )
