import json

import pytest
from pyspark.sql import functions as F

from busweave import constants as K
from busweave.functions import replies as R
from busweave.operators import samples as SAM, scoring as SCO

FENCE = "```"


@pytest.mark.parametrize("text, expected", [
    (f'{FENCE}json\n{{"a":1}}\n{FENCE}', '{"a":1}'), (f"{FENCE}\nx\n{FENCE}", "x"),
    (f" {FENCE}json x", f"{FENCE}json x"), (f"{FENCE}json{FENCE}x", "x"), ("  x\n", "x"), (FENCE, ""),
])
def test_clean_response(spark, text, expected):
    got = spark.createDataFrame([(text,)], "v string").select(R.clean_response(F.col("v")).alias("x"))
    assert got.first()["x"] == expected


@pytest.mark.parametrize("reply, outcome, time, service", [
    ('{"type": "rx", "time": "t", "serviceId": 5}', "parsed", "t", 5),
    ('{"type": "tx", "serviceId": "5"}', "parsed", "", None),
    ('{"type": "ignore"}', "ignored", "", None),
    ('{"error": "not_someip"}', "error", "", None),
    ('{"type": "RX"}', "error", "", None),
    ('{"type": 1}', "error", "", None),
    ("[1]", "error", None, None),
    ("5", "error", None, None),
    ("null", "error", None, None),
    ('{"type": "rx"', "error", None, None),
    ('{"type": "rx", "Timestamp": "c", "Time": "b", "timestamp": "a"}', "parsed", "a", None),
    ('{"type": "rx", "time": null, "timestamp": "a"}', "parsed", None, None),
])
def test_replies(spark, reply, outcome, time, service):
    row = SCO.read_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (row["outcome"], row["time"], row["service_id"]) == (outcome, time, service)


@pytest.mark.parametrize("length, budget", [(10, 150), (245, 150), (300, 205), (795, 700), (5000, 700)])
def test_budget(spark, length, budget):
    assert spark.range(1).select(R.token_budget(F.lit(length)).alias("x")).first()["x"] == budget


def test_length_stats_of_nothing(spark):
    row = SCO.line_length_stats(spark.createDataFrame([], "line_no bigint, value string")).first()
    assert row["min_length"] is None and row["batches"] == 0


def test_failed_batch_stays_alone(spark):
    # Nested, so that it travels to the workers by value.
    def make_picky():
        import json as text

        def scorer(prompts, budget):
            if any("poison" in p for p in prompts):
                raise RuntimeError("no answer")
            return [text.dumps({"type": "rx", "budget": budget, "n": len(prompts)}) for _ in prompts]

        return scorer

    rows = [(i, "x" * (300 + i // 8)) for i in range(40)] + [(99, "poison" + "y" * 400)]
    lines = spark.createDataFrame(rows, "line_no bigint, value string").coalesce(1)
    got = {r["line_no"]: r for r in SCO.score_in_batches(lines, make_picky).collect()}
    assert len(got) == 41 and got[99]["failed"] and got[99]["error"] == "RuntimeError: no answer"
    good = [r for r in got.values() if not r["failed"]]
    assert len(good) >= 33 and all(r["error"] is None for r in good)
    assert all(json.loads(r["reply"])["n"] <= K.BATCH_LINES for r in good)
    assert all(json.loads(r["reply"])["budget"] == r["budget"] for r in good)


LINES = [
    "06-01 17:50:04.803 D s: SomeipCOmm :: RX Message [0/1]:service:c7 ,Method:80e5,payload:01 c6 ",
    "06-01 17:50:05.803 D s: TX Message SomeipComm::send  : service:193,method:4, response Payload: 0a ",
    "06-01 17:50:06.803 I link: idle",
]


def labelled(spark):
    return SAM.label_log_lines(
        spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, value string"), "Do it."
    )


def test_labels_are_indented_json(spark):
    rows = labelled(spark).orderBy("line_no").collect()
    want = {"time": "06-01 17:50:04.803", "type": "rx", "serviceId": 199, "methodId": 0x80E5, "payload": "01 c6"}
    assert rows[0]["answer"] == json.dumps(want, indent=2)
    assert rows[2]["answer"] == json.dumps({"error": "not_someip"}, indent=2)
    assert rows[0]["text"] == (
        f"### Instruction:\nDo it.\n\n### Input:\n{LINES[0]}\n\n### Response:\n{rows[0]['answer']}"
    )


def test_audit(spark):
    samples = labelled(spark).unionByName(
        labelled(spark).withColumn("text", F.replace("text", F.lit('"serviceId": 199'), F.lit('"serviceId": 1')))
    ).unionByName(labelled(spark).limit(1).withColumn("text", F.lit("no header")))
    counts = {r["sample_type"]: r["samples"] for r in SAM.sample_type_counts(samples).collect()}
    assert counts == {"rx": 2, "tx": 2, "not_someip": 2, "parse_error": 1}
    assert tuple(SAM.hex_conversion_audit(samples).first()) == (1, 1)
    assert sum(SAM.hex_conversion_audit(samples, 1).first()) == 1
    sizes = {r["size_class"]: (r["samples"], r["percent"]) for r in SAM.payload_size_histogram(samples).collect()}
    assert sizes["1-10"] == (4, 100.0) and sizes["201-240"] == (0, 0.0) and len(sizes) == 7


@pytest.mark.parametrize("size, label", [
    (0, "1-10"), (10, "1-10"), (11, "11-20"), (50, "21-50"), (100, "51-100"), (150, "101-150"),
    (200, "151-200"), (201, "201-240"), (999, "201-240"),
])
def test_size_class(spark, size, label):
    assert spark.range(1).select(SAM.size_class(F.lit(size)).alias("x")).first()["x"] == label


def test_split_does_not_depend_on_partitions(spark):
    rows = spark.range(2000).withColumnRenamed("id", "line_no")
    split = lambda df: {r["line_no"]: r["split"] for r in SAM.split_train_val(df, "line_no").collect()}
    assert split(rows) == split(rows.repartition(7))
    assert 0.87 < sum(v == "train" for v in split(rows).values()) / 2000 < 0.93


def test_quota_limits_before_the_shuffle(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("line_no"), F.when(F.col("id") % 3 > 0, "rx_known").otherwise("ignore").alias("stratum")
    )
    got = SAM.quota_sample(rows, "line_no")
    assert {(r["stratum"], r["count"]) for r in got.groupBy("stratum").count().collect()} == {
        ("rx_known", 400), ("ignore", 200),
    }
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_known_pairs(spark):
    rows = [("rx", 0xC7, 0x80E5), ("rx", 1, 1), ("tx", 193, 4), ("rx", 193, 4), ("rx", None, None)]
    frame = spark.createDataFrame(rows, "type string, service_id bigint, method_id bigint")
    got = {(r["type"], r["service_id"]): r["known"] for r in SAM.known_pair_flag(frame).collect()}
    assert got == {("rx", 0xC7): True, ("rx", 1): False, ("tx", 193): True, ("rx", 193): False, ("rx", None): False}
