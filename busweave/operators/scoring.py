"""Batches of lines for a scorer, and what its replies amount to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from busweave import constants as K
from busweave.functions import replies as R
from busweave.functions.text import is_message_line
from busweave.operators.computed import with_computed
from busweave.operators.ordered import global_position

Scorer = Callable[[list[str], int], list[str]]


def sort_by_length(lines: DataFrame, key: str = "line_no") -> DataFrame:
    """Lines by ascending length, ties in input order."""
    return lines.withColumn("length", F.length("value")).orderBy("length", key)


def sort_by_time_text(rows: DataFrame, ties: Sequence[str] = ("line_no",)) -> DataFrame:
    """Rows by time text, a missing time first."""
    return rows.orderBy(F.coalesce("time", F.lit("")), *ties)


def line_length_stats(lines: DataFrame) -> DataFrame:
    """Shortest and longest line with their budgets, and the number of batches."""
    stats = lines.agg(
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.count("*").alias("lines"),
    )
    return stats.select(
        "min_length",
        "max_length",
        R.token_budget(F.col("min_length")).alias("min_budget"),
        R.token_budget(F.col("max_length")).alias("max_budget"),
        F.ceil(F.col("lines") / K.BATCH_LINES).cast("bigint").alias("batches"),
    )


def batch_by_length(
    lines: DataFrame, key: str = "line_no", batch_lines: int = K.BATCH_LINES
) -> DataFrame:
    """Cut the lines, sorted by length, into batches; budget of the longest line.

    Positions are exact over the whole table although no task sees all of it.
    """
    sized = lines.withColumn("length", F.length("value"))
    placed = global_position(sized, ["length", key], "_place")
    batched = placed.withColumn(
        "batch", F.floor(F.col("_place") / batch_lines).cast("bigint")
    )
    longest = F.max("length").over(Window.partitionBy("batch"))
    return batched.withColumn("budget", R.token_budget(longest)).drop("_place")


def score_in_batches(
    lines: DataFrame,
    make_scorer: Callable[[], Scorer],
    instruction: str = R.DEFAULT_INSTRUCTION,
    key: str = "line_no",
    batch_lines: int = K.BATCH_LINES,
) -> DataFrame:
    """Send prompts in batches of similar length: ``(key, reply, failed, error, budget)``.

    ``make_scorer`` runs once per task; let it cache its model per worker.  Rows
    are range-partitioned by length, so a common length still spreads over many
    tasks.  A batch whose call fails marks its own rows, with the reason in
    ``error``, and the rest go on.
    """
    key_type = lines.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, key_type),
        T.StructField("reply", T.StringType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("budget", T.IntegerType()),
    ])
    prompts = (
        lines.select(
            key,
            F.length("value").alias("length"),
            R.build_prompt(F.col("value"), instruction).alias("prompt"),
        )
        .repartitionByRange("length", key)
        .sortWithinPartitions("length", key)
    )
    low, high, less = K.MIN_BUDGET, K.MAX_BUDGET, K.BUDGET_OFFSET

    def run(frames):
        import pandas as pd

        scorer = make_scorer()

        def score(prompts, longest):
            budget = int(max(low, min(longest - less, high)))
            size = len(prompts)
            try:
                replies, error = list(scorer(prompts, budget)), None
                if len(replies) != size:
                    # they cannot be put beside the prompts
                    replies, error = [None] * size, f"{len(replies)} replies to {size} prompts"
            except Exception as failure:
                replies, error = [None] * size, f"{type(failure).__name__}: {failure}"
            errors = [error or ("no reply" if reply is None else None) for reply in replies]
            return replies, errors, [budget] * size

        def score_rows(rows):
            """One output frame for a run of whole batches (or the last rest)."""
            texts, lengths = rows["prompt"].tolist(), rows["length"].tolist()
            replies, errors, budgets = [], [], []
            for at in range(0, len(texts), batch_lines):
                # Lines are sorted, so the last of a batch is its longest.
                batch = texts[at:at + batch_lines]
                got, why, spent = score(batch, lengths[at + len(batch) - 1])
                replies += got
                errors += why
                budgets += spent
            return pd.DataFrame({
                key: rows[key].to_numpy(),
                "reply": replies,
                "failed": [reply is None for reply in replies],
                "error": errors,
                "budget": budgets,
            })

        rest = None
        for frame in frames:
            if rest is not None and len(rest):
                frame = pd.concat([rest, frame], ignore_index=True)
            whole = len(frame) - len(frame) % batch_lines
            if whole:
                yield score_rows(frame.iloc[:whole])
            rest = frame.iloc[whole:]
        if rest is not None and len(rest):
            yield score_rows(rest)

    return prompts.mapInPandas(run, schema)


def read_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Reply fields and ``outcome``: parsed, ignored or error."""
    reply = F.col("_reply")
    parsed = replies.withColumn(
        "_reply", R.parse_response(R.clean_response(F.col(column)))
    )
    return with_computed(
        parsed,
        {
            "outcome": R.reply_class(reply),
            "time": F.when(R.is_object(reply), R.reply_time(reply)),
            "type": R.text_field(reply, "type"),
            "service_id": R.integer_field(reply, "serviceId"),
            "method_id": R.integer_field(reply, "methodId"),
            "payload": R.text_field(reply, "payload"),
        },
        keep=replies.columns,
    )


def reply_counts(lines: DataFrame, replies: DataFrame) -> DataFrame:
    """Lines read, kept and skipped, and their replies parsed, ignored or failed.

    ``replies`` holds an ``outcome`` per kept line.
    """
    kept = is_message_line(F.col("value"))
    read = lines.agg(
        F.count("*").alias("read_lines"),
        F.count_if(kept).alias("kept_lines"),
        F.count_if(~kept).alias("skipped_lines"),
    )
    outcome = F.col("outcome")
    answered = replies.agg(
        F.count_if(outcome == "parsed").alias("parsed"),
        F.count_if(outcome == "ignored").alias("ignored"),
        F.count_if(outcome == "error").alias("errors"),
    )
    names = read.columns + answered.columns
    both = read.unionByName(answered, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in names])
