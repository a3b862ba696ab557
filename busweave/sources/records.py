"""JSON records, the nested signal dictionary, training sets."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from busweave import constants as K, schemas
from busweave.functions.text import log_timestamp
from busweave.operators.scoring import read_replies
from busweave.operators.windowing import filter_time_window


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array (or JSON lines spread over rows) of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line: splittable, the form to use for large inputs."""
    return spark.read.schema(schema).json(path)


def _row_order() -> Column:
    """Order of rows within and across files."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ).alias("row_no")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records with a row order and plain column names."""
    records = read_json_records(spark, path, schemas.CATALOGUE_RECORD)
    return records.select(
        _row_order(),
        F.col("messagename").alias("message_name"),
        F.coalesce("isCAN", F.lit(False)).alias("is_can"),
        F.col("service id").alias("service_id"),
        F.col("method id").alias("method_id"),
        "direction",
    )


def read_noncan_signals(spark: SparkSession, path: str) -> DataFrame:
    records = read_json_records(spark, path, schemas.NONCAN_RECORD)
    return records.select(
        _row_order(),
        F.col("messageName").alias("message_name"),
        "signals",
    )


def flatten_signal_dictionary(documents: DataFrame, text: Column) -> DataFrame:
    """One row per signal of nested dictionary texts, with its place in the text.

    ``place`` is (file, namespace, message, signal) position: the order in which
    a lookup would meet the entries of one direction.  A ``file`` column, if the
    documents have one, comes first.
    """
    file = F.col("file") if "file" in documents.columns else F.lit("")
    parsed = documents.select(
        file.alias("_f"),
        F.posexplode(F.from_json(text, schemas.SIGNAL_DICTIONARY)).alias(
            "_d", "direction", "_namespaces"
        )
    )
    parsed = parsed.select(
        "_f", "direction", F.posexplode("_namespaces").alias("_n", "namespace", "_messages")
    )
    parsed = parsed.select(
        "_f", "direction", "namespace", "_n",
        F.posexplode("_messages").alias("_m", "message", "_signals"),
    )
    parsed = parsed.select(
        "_f", "direction", "namespace", "message", "_n", "_m",
        F.posexplode("_signals").alias("_s", "signal", "_definition"),
    )
    return parsed.select(
        "direction", "namespace", "message", "signal",
        F.struct(
            F.col("_f").alias("file"),
            F.col("_n").alias("namespace"),
            F.col("_m").alias("message"),
            F.col("_s").alias("signal"),
        ).alias("place"),
        "_definition.*",
    )


def read_signal_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of nested dictionary files; each file is one JSON document."""
    documents = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file")
    )
    return flatten_signal_dictionary(documents, F.col("value"))


def read_found_messages(
    spark: SparkSession, path: str, json_lines: bool = False
) -> DataFrame:
    """``(place, time, type, service_id, method_id, payload)`` of a scorer's output.

    The output is one JSON array per file, or one object per line; the latter
    is splittable.  The time may stand under any of its four keys.  ``place``
    is the order of the records.
    """
    if json_lines:
        texts = spark.read.text(path).select(
            _row_order().alias("place"), F.col("value").alias("reply")
        )
    else:
        arrays = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("_file"),
            F.posexplode(F.from_json("value", "array<variant>")).alias("_at", "_record"),
        )
        texts = arrays.select(
            F.struct(F.col("_file").alias("file"), F.col("_at").alias("at")).alias("place"),
            F.to_json("_record").alias("reply"),
        )
    return read_replies(texts).select(
        "place", "time", "type", "service_id", "method_id", "payload"
    )


def read_message_table(
    spark: SparkSession,
    path: str,
    target: Column,
    seconds: float = K.WINDOW_SECONDS,
    anchor_year: int = 1900,
) -> DataFrame:
    """Messages of a written table around a target time, with their ``ts``.

    Only the days of the window are read; within them, times compare as text,
    which the reader can push down, before the exact test.  A window that ends in
    the next year reads from its first day on and up to its last.
    """
    half = F.make_dt_interval(secs=F.lit(Decimal(str(seconds))))
    low, high = target - half, target + half
    text = lambda ts, form: F.date_format(ts, form)
    first, last, day = text(low, "MM-dd"), text(high, "MM-dd"), F.col("day")
    next_second = text(high + F.expr("INTERVAL 1 SECOND"), "MM-dd HH:mm:ss")
    time, day_known = F.col("time"), first <= last
    near = F.when(day_known, (day >= first) & (day <= last)).otherwise((day >= first) | (day <= last))
    within = ~day_known | ((time >= text(low, "MM-dd HH:mm:ss")) & (time <= next_second))
    rows = spark.read.parquet(path).filter(near).filter(within)
    timed = rows.withColumn("ts", log_timestamp(time, anchor_year)).drop("day")
    return filter_time_window(timed, target, seconds)


def read_training_sets(spark: SparkSession, train: str, validation: str) -> DataFrame:
    """``(split, text)`` of both JSON-lines sets."""
    parts = [
        read_json_lines(spark, path, schemas.TRAINING_SAMPLE).select(
            F.lit(name).alias("split"), "text"
        )
        for name, path in (("train", train), ("validation", validation))
    ]
    return parts[0].unionByName(parts[1])


def count_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count("*").alias("samples"))
