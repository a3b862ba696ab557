"""Instruction samples of log lines: labels, strata, split and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from busweave import constants as K
from busweave.functions import frames as B
from busweave.functions import replies as R
from busweave.operators.computed import with_computed
from busweave.operators.messages import with_message
from busweave.session import fixed_rows


def label_log_lines(lines: DataFrame, instruction: str = R.DEFAULT_INSTRUCTION) -> DataFrame:
    """Expected answer and sample text of every line.

    ``kind`` is rx, tx or the not-a-message mark.
    """
    labelled = with_message(lines)
    answer = R.message_answer(F.col("message"))
    return labelled.withColumns(
        {
            "kind": F.coalesce(F.col("message.type"), F.lit(K.NOT_A_MESSAGE)),
            "answer": answer,
        }
    ).withColumn(
        "text", R.training_text(F.col("value"), F.col("answer"), instruction)
    )


def known_pairs(spark: SparkSession) -> DataFrame:
    """The fixed table of known (type, service, method) triples."""
    rows = [("rx", s, m) for s, m in K.KNOWN_RX_PAIRS]
    rows += [("tx", s, m) for s, m in K.KNOWN_TX_PAIRS]
    return fixed_rows(spark, "type string, service_id bigint, method_id bigint", rows)


def known_pair_flag(messages: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Add ``known``.

    The fixed pair table holds a few dozen rows and is broadcast; a caller's own
    table is joined as its measured size allows.
    """
    keys = ["type", "service_id", "method_id"]
    if pairs is None:
        pairs = F.broadcast(known_pairs(messages.sparkSession))
    else:
        pairs = pairs.select(*keys).distinct()
    flagged = pairs.withColumn("known", F.lit(True))
    return messages.join(flagged, keys, "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def _response(text: Column) -> Column:
    header = K.RESPONSE_HEADER
    at = F.instr(text, header)
    return F.when(
        at > 0, F.substring(text, at + len(header), F.length(text))
    )


def read_samples(samples: DataFrame) -> DataFrame:
    """Parsed answer of each sample text: ``sample_type``, ids and payload.

    ``sample_type`` is the answer's type, the not-a-message mark when it holds an
    error, or ``parse_error``.
    """
    reply = F.col("_reply")
    object_ = R.is_object(reply)
    has_error = F.try_variant_get(reply, "$.error", "variant").isNotNull()
    parsed = samples.withColumn("_reply", F.try_parse_json(_response(F.col("text"))))
    return with_computed(
        parsed,
        {
            "sample_type": F.when(~object_, "parse_error")
            .when(has_error, K.NOT_A_MESSAGE)
            .otherwise(F.coalesce(R.text_field(reply, "type"), F.lit(""))),
            "service_id": R.integer_field(reply, "serviceId"),
            "method_id": R.integer_field(reply, "methodId"),
            "payload": R.text_field(reply, "payload"),
        },
        keep=samples.columns,
    )


def sample_type_counts(samples: DataFrame) -> DataFrame:
    """Samples per type; the four standard types appear even when empty."""
    spark = samples.sparkSession
    counted = read_samples(samples).groupBy("sample_type").agg(F.count("*").alias("samples"))
    standard = fixed_rows(
        spark, "sample_type string, samples bigint", [(t, 0) for t in K.SAMPLE_TYPES]
    )
    return counted.unionByName(standard).groupBy("sample_type").agg(
        F.sum("samples").alias("samples")
    )


def size_class(byte_count: Column) -> Column:
    label = F.lit(K.SIZE_CLASSES[-1][0])
    for name, upper in reversed(K.SIZE_CLASSES[:-1]):
        label = F.when(byte_count <= upper, name).otherwise(label)
    return label


def payload_size_histogram(samples: DataFrame) -> DataFrame:
    """Count and percentage per size class over rx and tx samples.

    All classes appear.  One aggregate row holds every class, so counts and
    total come from a single pass.
    """
    sized = read_samples(samples).filter(
        ~F.col("sample_type").isin(K.NOT_A_MESSAGE, "parse_error")
    )
    size = F.size(B.payload_bytes(F.coalesce("payload", F.lit(""))))
    classed = sized.withColumn("_size", size).select(size_class(F.col("_size")).alias("_class"))
    labels = [name for name, _ in K.SIZE_CLASSES]
    row = classed.agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.col("_class") == name).alias(name) for name in labels],
    )
    total = F.greatest("_total", F.lit(1))
    entries = [
        F.struct(
            F.lit(name).alias("size_class"),
            F.col(name).alias("samples"),
            (100.0 * F.col(name) / total).alias("percent"),
        )
        for name in labels
    ]
    return row.select(F.inline(F.array(*entries)))


# Fixed value: how the ids stand in a received line.
_AUDIT_IDS = r"service:([0-9a-f]+) ,Method:([0-9a-f]+)"


def hex_conversion_audit(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of rx samples read again from the input line, against the answer.

    Lines the pattern does not fit count in neither column.  ``limit`` checks
    only that many samples, as a spot check would: the first by text.
    """
    text = F.col("text")
    start = F.instr(text, K.INPUT_HEADER) + len(K.INPUT_HEADER)
    line = F.substring(text, start, F.instr(text, K.RESPONSE_HEADER) - start)
    rows = read_samples(samples).filter(F.col("sample_type") == "rx")
    rows = rows.withColumn("_line", line).filter(F.col("_line").rlike(_AUDIT_IDS))
    if limit is not None:
        rows = rows.orderBy("text").limit(limit)
    from_line = lambda i: F.conv(
        F.regexp_extract("_line", _AUDIT_IDS, i), 16, 10
    ).try_cast("bigint")
    right = (from_line(1) == F.col("service_id")) & (from_line(2) == F.col("method_id"))
    right = F.coalesce(right, F.lit(False))
    return rows.agg(
        F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong")
    )


def _draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffle_samples(samples: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed pseudo-random order that does not depend on partitioning."""
    return samples.withColumn("draw", _draw(seed, key)).orderBy("draw", key)


def split_train_val(
    samples: DataFrame, key: str, seed: int = 42, share: float = 0.9
) -> DataFrame:
    """``split`` by hash threshold: about ``share`` train, stable for each row."""
    place = F.conv(F.left(_draw(seed, key), F.lit(15)), 16, 10).cast("bigint")
    return samples.withColumn(
        "split",
        F.when(place < int(share * (1 << 60)), "train").otherwise("validation"),
    )


def stratum(kind: Column, byte_count: Column, known: Column) -> Column:
    big = byte_count >= K.BIG_PAYLOAD_BYTES
    return (
        F.when((kind == "rx") & big, "rx_big")
        .when((kind == "tx") & big, "tx_big")
        .when((kind == "rx") & known, "rx_known")
        .when(kind == "rx", "rx_other")
        .when(kind == "tx", "tx_any")
        .otherwise("ignore")
    )


def quota_sample(
    rows: DataFrame, key: str, seed: int = 42, quotas: dict[str, int] | None = None
) -> DataFrame:
    """A fixed number of rows per ``stratum``, drawn by hash.

    Draws are uniform, so counting them by their first digits finds, per
    stratum, the prefix at which its quota is reached; only rows up to it are
    ranked.  A stratum or quota of any size leaves about its quota of rows.
    """
    quotas = quotas or K.STRATUM_QUOTAS
    quota = F.lit(0)
    for name, wanted in quotas.items():
        quota = F.when(F.col("stratum") == name, wanted).otherwise(quota)
    drawn = rows.withColumn("draw", _draw(seed, key))
    prefix = F.left("draw", F.lit(4))
    counts = drawn.groupBy("stratum", prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("stratum").orderBy("_prefix").rowsBetween(
        Window.unboundedPreceding, -1
    )
    reach = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = reach.filter(F.col("_before") < quota).groupBy("stratum").agg(
        F.max("_prefix").alias("_last")
    ).withColumnRenamed("stratum", "_stratum")
    near = drawn.join(last, F.col("stratum").eqNullSafe(F.col("_stratum"))).filter(
        prefix <= F.col("_last")
    )
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("draw", key))
    # the plain number lets every task keep no more than the largest quota of a stratum
    ranked = near.withColumn("place", rank).filter(F.col("place") <= max(quotas.values(), default=0))
    return ranked.filter(F.col("place") <= quota).drop(
        "draw", "_stratum", "_last"
    )


def example_per_type(samples: DataFrame, key: str, type_column: str = "kind") -> DataFrame:
    """First sample text of each type."""
    return samples.groupBy(type_column).agg(F.min_by("text", key).alias("text"))
