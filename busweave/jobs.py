"""Command-line jobs over files: ``spark-submit busweave/jobs.py <job> ...``.

Every job reads files, applies the operators and writes folders next to each
other below ``--out``.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from busweave import constants as K, schemas  # noqa: E402
from busweave.functions.frames import payload_bytes  # noqa: E402
from busweave.functions.text import target_timestamp  # noqa: E402
from busweave.operators import (  # noqa: E402
    accuracy, catalogue as sheet_ops, dictionary as dictionary_ops, samples, series, windowing,
)
from busweave.operators.messages import extract_messages  # noqa: E402
from busweave.plans import analysis, scoring as scoring_plan  # noqa: E402
from busweave.sources import ingest as growing, logs, records, sheets, sinks  # noqa: E402


def _target(text: str, year: int):
    target = target_timestamp(F.lit(text), year)
    return F.coalesce(target, F.raise_error(F.lit(f"cannot read time {text!r}")))


def analyze(spark, args) -> None:
    """Log, references, properties and a time to matches, definitions, values, steps."""
    lines = logs.read_log_lines(spark, args.log, args.year).withColumn(
        "line_no", F.col("line_key")
    )
    target = _target(args.time, args.year)
    window = analysis.settle(
        windowing.window_with_continuations(lines, target, args.seconds), "slice"
    )
    messages = analysis.settle(extract_messages(window), "window-messages")
    result = analysis.analyze_properties(
        spark.read.text(args.properties).select(F.trim("value").alias("query_signal")),
        messages,
        records.read_catalogue(spark, args.catalogue),
        records.read_noncan_signals(spark, args.lists),
        spark.read.parquet(args.dictionary) if args.flat_dictionary
        else records.read_signal_dictionary(spark, args.dictionary),
    )
    ordered = window.repartitionByRange("line_key").sortWithinPartitions("line_key")
    sinks.write_text_lines(ordered, f"{args.out}/window")
    sinks.write_json_records(analysis.nested_matches(result.matches), f"{args.out}/matches")
    sinks.write_json_records(result.definitions, f"{args.out}/definitions")
    decoded = analysis.settle(result.decoded, "decoded")
    sinks.write_json_records(decoded.drop("line_no"), f"{args.out}/decoded")
    sinks.write_json_records(result.rejected, f"{args.out}/rejected")
    points = series.signal_points(decoded, target, args.seconds, args.year)
    steps = series.step_intervals(points).drop("line_no")
    sinks.write_json_records(steps, f"{args.out}/steps")


def references(spark, args) -> None:
    """Exported sheet to catalogue and signal lists, in the form ``analyze`` reads."""
    rows = sheets.read_catalogue_rows(spark, args.sheet, args.row_number_column)
    catalogue = sheet_ops.build_catalogue(rows).select(
        F.col("message_name").alias("messagename"), F.col("is_can").alias("isCAN"),
        F.col("service_id").alias("service id"), F.col("method_id").alias("method id"),
        "direction", "row_no",
    )
    in_order = lambda df, key: df.repartitionByRange(key).sortWithinPartitions(key).drop(key)
    sinks.write_json_records(in_order(catalogue, "row_no"), f"{args.out}/catalogue")
    lists = sheet_ops.signals_per_message(rows).select(
        F.col("message_name").alias("messageName"), "signals", "group_no"
    )
    sinks.write_json_records(in_order(lists, "group_no"), f"{args.out}/lists")
    sinks.write_json_records(sheet_ops.catalogue_counts(rows), f"{args.out}/counts")


def dictionary(spark, args) -> None:
    """Flat bus tables to dictionary rows and requestable signal names."""
    flat = dictionary_ops.build_signal_dictionary(
        spark.read.parquet(args.messages), spark.read.parquet(args.signals)
    )
    flat.write.parquet(f"{args.out}/dictionary")
    names = dictionary_ops.format_signal_names(spark.read.parquet(f"{args.out}/dictionary"))
    sinks.write_text_lines(names, f"{args.out}/names", "name")


def score_accuracy(spark, args) -> None:
    """Log against a scorer's output: level counts and mismatch details."""
    lines = logs.read_nonblank_lines(spark, args.log)
    truth = analysis.settle(
        extract_messages(lines.select("line_key", "value")), "truth"
    )
    found = analysis.settle(
        records.read_found_messages(spark, args.found, args.json_lines), "found"
    )
    sinks.write_json_records(accuracy.accuracy_report(truth, found), f"{args.out}/report")
    sinks.write_json_records(
        accuracy.accuracy_mismatch_detail(truth, found), f"{args.out}/mismatches"
    )
    sinks.write_json_records(
        accuracy.accuracy_missing(truth, found).drop("line_key"), f"{args.out}/missing"
    )


def score_log(spark, args) -> None:
    """Log lines through a scorer: found messages in time order, and counts.

    ``scorer`` names a factory as module:function.
    """
    module, _, name = args.scorer.partition(":")
    factory = getattr(importlib.import_module(module), name)
    lines = logs.read_nonblank_lines(spark, args.log).select("line_key", "value")
    keyed = lines.withColumn("line_no", F.to_json("line_key")).drop("line_key")
    run = scoring_plan.score_log(keyed, factory)
    sinks.write_time_ordered(
        scoring_plan.found_records(run.replies), f"{args.out}/found", ties=("payload",)
    )
    sinks.write_json_records(run.counts, f"{args.out}/counts")


def training_set(spark, args) -> None:
    """Log lines to labelled samples, split for training, with an audit.

    The split follows the line's text, so equal lines stay on one side and other
    files or partitions change nothing.  ``--quotas`` draws the fixed number of
    each stratum first; samples are written in a fixed pseudo-random order.
    """
    lines = logs.read_nonblank_lines(spark, args.log).select("line_key", "value")
    labelled = samples.label_log_lines(lines)
    labelled = labelled.withColumn("id", F.md5("value"))
    if args.quotas:
        flagged = samples.known_pair_flag(labelled.select("id", "kind", "text", "message.*"))
        size = F.size(payload_bytes(F.coalesce("payload", F.lit(""))))
        stratum = samples.stratum(F.col("kind"), size, F.col("known"))
        labelled = samples.quota_sample(flagged.withColumn("stratum", stratum), "id", args.seed)
    split = samples.split_train_val(labelled.select("id", "text"), "id", args.seed)
    sinks.write_jsonl_split(samples.shuffle_samples(split, "id", args.seed), f"{args.out}/samples")
    written = spark.read.schema(schemas.TRAINING_SAMPLE).json(f"{args.out}/samples")
    audits = {
        "types": samples.sample_type_counts(written),
        "sizes": samples.payload_size_histogram(written),
        "ids": samples.hex_conversion_audit(written),
    }
    for name, audit in audits.items():
        sinks.write_json_records(audit, f"{args.out}/audit-{name}")


def ingest(spark, args) -> None:
    """New lines of a growing log folder to messages, appended to a table as one batch."""
    batch = growing.ingest(spark, args.folder, args.out, most_bytes=args.most_bytes)
    print(f"batch {batch}" if batch else "nothing new")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="busweave")
    jobs = parser.add_subparsers(required=True)

    def job(run, *paths):
        one = jobs.add_parser(run.__name__, help=run.__doc__)
        for path in (*paths, "out"):
            one.add_argument(f"--{path}", required=True)
        one.set_defaults(run=run)
        return one

    one = job(analyze, "log", "time", "properties", "catalogue", "lists", "dictionary")
    one.add_argument("--seconds", type=float, default=K.WINDOW_SECONDS)
    one.add_argument("--year", type=int, default=1900)
    one.add_argument("--flat-dictionary", action="store_true", help="as the dictionary job writes it")
    one = job(references, "sheet")
    one.add_argument("--row-number-column", type=int, default=K.SHEET_SIGNAL_NAME + 1)
    job(dictionary, "messages", "signals")
    job(score_accuracy, "log", "found").add_argument("--json-lines", action="store_true")
    job(score_log, "log", "scorer")
    job(ingest, "folder").add_argument("--most-bytes", type=int, help="of each file in one run")
    one = job(training_set, "log")
    one.add_argument("--seed", type=int, default=42)
    one.add_argument("--quotas", action="store_true")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("busweave").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
