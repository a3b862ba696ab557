"""No size at which a value is dropped: bits, ids, shares, quotas, repeated requests."""

import random

import pytest
from busweave.functions import cells, frames as B, text as X
from busweave.operators import decoding, samples
from busweave.operators.scoring import score_in_batches
from pyspark.sql import functions as F


def walk(data: bytes, start_bit: int, length: int) -> str:
    """Bits from the most significant on; places before the byte are zeros."""
    bits = "".join(f"{b:08b}" for b in data)
    return "".join(bits[i] if i >= 0 else "0" for i in range(7 - start_bit, 7 - start_bit + length))


def test_bits_of_any_length_and_start(spark):
    rng = random.Random(4)
    rows, want = [], []
    for _ in range(300):
        start_bit, length = rng.randrange(21), rng.randrange(1, 201)
        body = rng.randbytes(max(1, (7 - start_bit + length + 7) // 8))
        rows.append((" ".join(f"{b:02x}" for b in bytes([1, 0x96, 1]) + body), start_bit, length))
        want.append(walk(body, start_bit, length))
    table = spark.createDataFrame(rows, "payload string, start_bit int, length int").withColumn("_frame", B.frame(F.col("payload")))
    field = B.BitField.of(F.lit(0), F.col("start_bit"), F.col("length"))
    bits = B.signal_bits(F.col("_frame"), field)
    got = table.select(
        B.skip_reason(F.col("_frame"), F.lit("0196"), field), bits, B.bits_to_number(bits), B.bits_to_double(bits)
    ).collect()
    for row, expected in zip(got, want):
        value = int(expected, 2)
        assert row[0] == "ok" and row[1] == expected
        assert row[2] == (value if value < 1 << 64 else None)
        assert row[3] == pytest.approx(float(value), rel=1e-12)


def test_ids_up_to_a_bigint(spark):
    row = spark.range(1).select(
        X._id_from_hex(F.lit("7000000000000001")), X._id_from_hex(F.lit("00" + "f" * 16)),
        cells.decimal_id(F.lit("0x7000000000000001")), cells.normalise_msg_type(F.lit("9999999999999999999")),
        cells.expand_signal_cell(F.lit("a[99999999999]\nb[2]")),
    ).first()
    assert row[0] == row[2] == 0x7000000000000001 and row[1] is None
    assert row[3] == hex(9999999999999999999) and row[4] == ["a[99999999999]", "b[0]", "b[1]"]


def test_odd_choice_keys(spark):
    row = spark.sql("SELECT map('2', 'a', 'x', 'b', '1', 'c') AS m, cast(18446744073709551615 AS decimal(20,0)) AS v")
    got = row.select(B.sorted_choice_keys(F.col("m")), B.choice_index(B.sorted_choice_keys(F.col("m")), F.col("v"))).first()
    assert got[0] == [1, 2] and got[1] == 0


def test_small_shares_and_large_quotas(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") < 30_000, "rx_other").otherwise("ignore").alias("stratum"))
    part = samples.split_train_val(rows, "id", share=0.002).filter("split = 'train'").count()
    assert 40 < part < 130
    drawn = samples.quota_sample(rows, "id", quotas={"rx_other": 5000, "ignore": 3})
    counts = {r.stratum: r["count"] for r in drawn.groupBy("stratum").count().collect()}
    assert counts == {"rx_other": 5000, "ignore": 3}
    ranked = {r.place for r in drawn.filter("stratum = 'rx_other'").collect()}
    assert ranked == set(range(1, 5001))


def test_repeated_requests_count_once_each(spark):
    matched = spark.createDataFrame(
        [("p", True, True, 1, "01 96 01 10")] * 3, "query_signal string, is_can boolean, matched boolean, line_no int, payload string"
    )
    one = spark.sql("SELECT 'p' AS query_signal, '0196' AS msgid, 0 AS start_byte, 7 AS start_bit, 8 AS length, "
                    "cast(map() AS map<string,string>) AS choices, 0d AS minimum, 99d AS maximum, 0d AS offset, 1d AS factor")
    assert decoding.decode_join(matched, one.union(one).union(one)).count() == 3


def test_wrong_number_of_replies_fails_the_batch(spark):
    lines = spark.createDataFrame([(i, "line") for i in range(4)], "line_no long, value string")
    for extra in (-1, 1):
        rows = score_in_batches(lines, lambda: lambda prompts, _: ["x"] * (len(prompts) + extra)).collect()
        assert all(r.failed and r.reply is None and r.error == f"{4 + extra} replies to 4 prompts" for r in rows)
