"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

The log text is derived from the tables once, untimed.  ``ingest_log`` times
text to message table (scan, five-field extraction, write), ``end_to_end`` raw
text to decoded values; the other queries run from the tables or from that message table and are timed end to end,
planning included, with all result rows produced: the median of BENCH_RUNS
runs.  The total leaves ``end_to_end`` out, to stay comparable between rounds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from busweave.operators.messages import extract_messages  # noqa: E402
from busweave.plans.analysis import analyze_log  # noqa: E402
from busweave.session import local_session, scratch_path  # noqa: E402
from busweave.sources import logs, sinks  # noqa: E402
from busweave.workload import bindings as D  # noqa: E402
from busweave.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "extract_messages", "filter_time_window", "window_with_continuations",
    "match_messages", "decode_join", "analyze_properties", "extract_bits",
    "change_points", "step_intervals", "asof_signal_value", "accuracy_report",
    "accuracy_mismatch_detail", "batch_by_length", "score_in_batches", "reply_counts",
    "label_log_lines", "quota_sample", "payload_size_histogram", "build_catalogue",
    "signals_per_message", "build_signal_dictionary", "scan_signal_dictionary",
)


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    folder = scratch_path(spark, "bench-log")
    lines = D.log_lines(spark, sf_dir).repartitionByRange("line_no")
    sinks.write_text_lines(lines.sortWithinPartitions("line_no"), folder)
    lines_total = spark.read.text(folder).count()

    def ingest(spark, sf_dir):
        messages = extract_messages(logs.read_log_lines(spark, folder).drop("ts"))
        path = scratch_path(spark, "bench-messages")
        sinks.write_message_table(messages, path)
        return spark.read.parquet(path)

    def end_to_end(spark, sf_dir):
        """Raw text to decoded values around a time, nothing written before."""
        lines = logs.read_log_lines(spark, folder).withColumn("line_no", F.col("line_key"))
        return analyze_log(
            lines, D.target(), D.HALF_WINDOW, "file_path", "line_key",
            D.properties(spark, sf_dir), D.catalogue(spark, sf_dir),
            D.noncan_records(spark, sf_dir), D.dictionary(spark, sf_dir),
        ).decoded

    D.message_table(spark, sf_dir)
    seconds = {}
    measured = {"ingest_log": ingest, "end_to_end": end_to_end}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name, query in {**measured, **{n: QUERIES[n] for n in HEADLINE}}.items():
        took = []
        for _ in range(runs):
            started = time.time()
            consume(query(spark, sf_dir))
            took.append(time.time() - started)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(s for n, s in seconds.items() if n != "end_to_end"), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "log_lines": lines_total,
        "log_lines_per_sec": round(lines_total / seconds["ingest_log"]),
    }))


if __name__ == "__main__":
    main()
