"""Growing log folders read once, byte for byte.

Every run reads what files have gained since the last one and appends it to a
table as one batch.  The ledger says, per file, up to which byte that is; it is
written after the batch, and its success marker commits both.  A run that dies
before has left a batch that no ledger names: readers pass it by, and the next
run, which starts from the same bytes, writes it anew.  So any sequence of killed
and repeated runs gives the same table.

Only complete lines are taken; a line without its end waits for the next run.
Tails are cut into byte ranges, so that one long file spreads over many tasks; a
range owns the lines that begin in it.  A file shorter than the ledger says was
replaced and is read from its start as the next ``generation``.  One run at a
time may write a table.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from busweave.operators.messages import extract_messages
from busweave.session import settle

# readers travel to the executors by value, which then need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 16 << 20
_BLOCK = 1 << 16
_MOST_TASKS = 50_000
_LINES = 20_000
_STATE = "path string, generation int, upto bigint"


def _opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(name)


def _last_line_end(source, low: int, high: int, length: int) -> int:
    """The byte after the last line end in [low, high), or after the next one; ``low`` if there is none."""
    at = high
    while at > low:
        start = max(low, at - _BLOCK)
        source.seek(start)
        place = source.read(at - start).rfind(b"\n")
        if place >= 0:
            return start + place + 1
        at = start
    at = high
    while at < length:
        source.seek(at)
        block = source.read(min(_BLOCK, length - at))
        place = block.find(b"\n")
        if place >= 0:
            return at + place + 1
        at += len(block)
    return low


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upto = []
        for row in batch.to_pylist():
            with _opened(row["path"]) as source:
                upto.append(_last_line_end(source, row["low"], row["high"], row["length"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("generation"), batch.column("low"), pa.array(upto, pa.int64())],
            names=["path", "generation", "low", "upto"],
        )


def _range_lines(source, low: int, high: int, begin: int, upto: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [low, high) of a tail [begin, upto)."""
    at = low
    if low > begin:
        # the range begins with a line only if the byte before ends one
        source.seek(low - 1)
        data, at = source.read(high - low + 1), low - 1
        place = data.find(b"\n")
        if place < 0 or at + place + 1 >= high:
            return
        data, at = data[place + 1 :], at + place + 1
    else:
        source.seek(low)
        data = source.read(high - low)
    while not data.endswith(b"\n"):
        source.seek(at + len(data))
        block = source.read(min(_BLOCK, upto - at - len(data)))
        place = block.find(b"\n")
        data += block if place < 0 else block[: place + 1]
    for line in data.split(b"\n")[:-1]:
        yield at, line.removesuffix(b"\r")
        at += len(line) + 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(path: str, generation: int, found: list) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * n, pa.string()), pa.array([generation] * n, pa.int32()),
                pa.array([at for at, _ in found], pa.int64()),
                pa.array([line.decode("utf-8", "replace") for _, line in found], pa.string()),
            ],
            names=["file_path", "generation", "line_key", "value"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            held = []
            with _opened(row["path"]) as source:
                for found in _range_lines(source, row["low"], row["high"], row["begin"], row["upto"]):
                    held.append(found)
                    if len(held) == _LINES:
                        yield rows(row["path"], row["generation"], held)
                        held = []
            yield rows(row["path"], row["generation"], held)


def _committed(spark: SparkSession, ledger: str) -> int:
    """Number of the last committed batch, 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    done = [
        int(s.getPath().getName().removeprefix("batch="))
        for s in files.listStatus(path)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done, default=0)


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the files of a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def ledger_state(spark: SparkSession, table: str) -> DataFrame:
    """``(path, generation, upto)`` of the last committed batch."""
    last = _committed(spark, f"{table}/ledger")
    if not last:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(f"{table}/ledger/batch={last}")


def new_tails(files: DataFrame, state: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """``(path, generation, low, high, length)`` of files that gained bytes."""
    known = state.withColumnRenamed("path", "_path")
    joined = files.join(known, F.col("path") == F.col("_path"), "left")
    replaced = F.col("length") < F.col("upto")
    low = F.when(replaced | F.col("upto").isNull(), F.lit(0)).otherwise(F.col("upto"))
    generation = F.coalesce(F.col("generation") + replaced.cast("int"), F.lit(0))
    tails = joined.select("path", generation.alias("generation"), low.cast("bigint").alias("low"), "length")
    high = F.col("length") if most_bytes is None else F.least("length", F.col("low") + most_bytes)
    return tails.withColumn("high", high.cast("bigint")).filter("high > low")


def _spread(rows: DataFrame) -> DataFrame:
    """Small rows that each stand for much reading, one task for every few."""
    return rows.repartition(min(max(rows.count(), 1), _MOST_TASKS))


def ingest(
    spark: SparkSession,
    folder: str,
    table: str,
    transform: Callable[[DataFrame], DataFrame] = extract_messages,
    most_bytes: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> int:
    """Append what the folder's files gained to ``table``; the batch's number, 0 if nothing came.

    ``transform`` gets lines (file_path, generation, line_key, value), with the
    byte offset as ``line_key``.  A run takes about ``most_bytes`` of each file.
    """
    batch = _committed(spark, f"{table}/ledger") + 1
    state = ledger_state(spark, table)
    tails = settle(new_tails(log_files(spark, folder), state, most_bytes), "tails")
    ended = _spread(tails).mapInArrow(_ends, "path string, generation int, low bigint, upto bigint")
    ended = settle(ended.filter("upto > low"), "ends")
    if ended.isEmpty():
        return 0
    low = F.explode(F.sequence(F.col("low"), F.col("upto") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = ended.select("path", "generation", F.col("low").alias("begin"), "upto", low.alias("low"))
    ranges = settle(ranges.withColumn("high", F.least("upto", F.col("low") + range_bytes)), "ranges")
    lines = _spread(ranges).mapInArrow(_lines, "file_path string, generation int, line_key bigint, value string")
    transform(lines).write.mode("overwrite").parquet(f"{table}/data/batch={batch}")
    _commit(state, ended, f"{table}/ledger/batch={batch}")
    return batch


def _commit(state: DataFrame, ended: DataFrame, path: str) -> None:
    """The places of all files; the success marker of this write commits the batch."""
    gained = ended.select("path", "generation", "upto")
    rest = state.join(gained.select("path"), "path", "left_anti").select("path", "generation", "upto")
    rest.unionByName(gained).write.mode("overwrite").parquet(path)


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """All committed rows with their ``batch``."""
    last = _committed(spark, f"{table}/ledger")
    if not last:
        raise ValueError(f"{table} holds no committed batch")
    return spark.read.parquet(f"{table}/data").filter(F.col("batch") <= last)
