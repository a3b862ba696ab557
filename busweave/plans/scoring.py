"""A whole scoring run over log lines."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from busweave import constants as K
from busweave.functions import replies as R
from busweave.operators.messages import filter_message_lines
from busweave.operators.scoring import Scorer, read_replies, reply_counts, score_in_batches
from busweave.session import settle


class ScoringRun(NamedTuple):
    """Parsed replies of message lines, and the counts of the run."""

    replies: DataFrame
    counts: DataFrame


def score_log(
    lines: DataFrame,
    make_scorer: Callable[[], Scorer],
    instruction: str = R.DEFAULT_INSTRUCTION,
    key: str = "line_no",
    batch_lines: int = K.BATCH_LINES,
) -> ScoringRun:
    """Prefilter, prompts, batches, replies and counts.

    Only message lines reach the scorer.  Its replies are written once, as they
    are costly; rows of failed batches count as errors.
    """
    kept = filter_message_lines(lines)
    scored = settle(score_in_batches(kept, make_scorer, instruction, key, batch_lines), "scored")
    replies = read_replies(scored)
    return ScoringRun(replies, reply_counts(lines, replies))


def found_records(replies: DataFrame) -> DataFrame:
    """Parsed replies in the form that accuracy reads."""
    return replies.filter(F.col("outcome") == "parsed").select(
        "time", "type",
        F.col("service_id").alias("serviceId"), F.col("method_id").alias("methodId"), "payload",
    )
