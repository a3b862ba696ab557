import random

import pytest
from pyspark.sql import functions as F

from busweave.functions import frames as B
from busweave.operators.decoding import decode_join
from busweave.plans.analysis import decode_messages

SCHEMA = (
    "query_signal string, msgid string, start_byte int, start_bit int, length int, "
    "choices map<string,string>, minimum double, maximum double, offset double, factor double"
)
SPEED = ("speed", "0197", 0, 7, 12, {}, 0.0, 127.96875, 0.0, 0.03125)
MODE = ("mode", "0197", 1, 3, 2, {"3": "Reserved", "2": "Odd", "1": "Reserved", "0": "Fine"},
        None, None, None, None)


def decode(spark, payload, *definitions):
    messages = spark.createDataFrame([(0, "t", payload)], "line_no bigint, time string, payload string")
    return decode_messages(messages, spark.createDataFrame(list(definitions), SCHEMA)).collect()


def test_scaled_signal(spark):
    (row,) = decode(spark, "01 97 01 12 34", SPEED)
    assert (int(row["signal_value"]), row["physical_value"], row["match_status"]) == (291, 9.09375, "valid")
    assert row["decoded_bits"] == "000100100011" and row["match_value"] == 9.09375


def test_choice_signal(spark):
    (row,) = decode(spark, "01 97 01 00 04", MODE)
    assert (int(row["signal_value"]), row["match_label"], row["match_status"]) == (1, "Reserved", "matched")
    assert row["match_value"] == 1.0 and row["physical_value"] is None


def test_unlabelled_choice_has_no_value(spark):
    part = (*MODE[:5], {"7": "x"}, *MODE[6:])
    (row,) = decode(spark, "01 97 01 00 04", part)
    assert (row["match_status"], row["match_value"]) == ("no_match", None)


def test_missing_limits_count_as_zero(spark):
    bare = ("bare", "0197", 0, 7, 8, None, None, None, None, None)
    (row,) = decode(spark, "01 97 01 05", bare)
    assert (row["match_status"], row["match_value"]) == ("out_of_range", 5.0)
    (row,) = decode(spark, "01 97 01 00", bare)
    assert row["match_status"] == "valid"


def reason(spark, payload, msgid="0197", start_byte=0, start_bit=7, length=12):
    frame = spark.createDataFrame(
        [(payload, msgid, start_byte, start_bit, length)],
        "p string, m string, sb int, st int, n int",
    )
    field = B.BitField.of(F.col("sb"), F.col("st"), F.col("n"))
    return frame.select(
        B.frame(F.col("p")).alias("f"), "m", "sb", "st", "n"
    ).select(B.skip_reason(F.col("f"), F.col("m"), field).alias("x")).first()["x"]


@pytest.mark.parametrize("payload, extra, expected", [
    ("01 97 01 12 34", {}, "ok"),
    ("01 98 01 00 00", {}, "id_mismatch"),
    ("01 97 00 12 34", {}, "status_not_ok"),
    ("01 97 01 12", {}, "short_bits"),
    ("01 97 01", {}, "short_start"),
    ("01 97", {}, "short_status"),
    ("01", {}, "short_id"),
    ("", {}, "short_id"),
    ("01 97 zz 12 34", {}, "bad_byte"),
    ("01 97 01 12 zz", {}, "bad_byte"),
    ("01 97 01 12 34 zz", {}, "ok"),
    ("01 97 01 12 34", {"length": 0}, "bad_length"),
    ("01 97 01 12 34", {"length": 65}, "short_bits"),
    ("01 97 01 11 22 33 44 55 66 77 88 99", {"length": 65}, "ok"),
    ("01 97 01 12 34", {"msgid": "01 97"}, "ok"),
    ("01 97 01 12 34", {"msgid": None}, "id_mismatch"),
    (" 01  97 01 12 34 ", {}, "ok"),
    ("01 97 1 2 34", {}, "ok"),
    ("01 AB 01 12 34", {"msgid": "01ab"}, "ok"),
])
def test_skip_reason(spark, payload, extra, expected):
    assert reason(spark, payload, **extra) == expected


def walk(payload, start_byte, start_bit, length):
    """Bit by bit, as an independent check; None when bytes run out."""
    data = [int(t, 16) for t in payload.split()]
    at, bit, value = 3 + start_byte, start_bit, 0
    for _ in range(length):
        if at >= len(data):
            return None
        value = value * 2 + (data[at] >> bit & 1)
        at, bit = (at, bit - 1) if bit else (at + 1, 7)
    return value


def test_bits_equal_a_plain_walk(spark):
    rng = random.Random(7)
    cases = []
    for i in range(1500):
        size = rng.randint(4, 16)
        payload = " ".join(["01", "97", "01"] + [f"{rng.randrange(256):02x}" for _ in range(size - 3)])
        cases.append((i, payload, rng.randint(0, 12), rng.randint(0, 7), rng.randint(1, 64)))
    frame = spark.createDataFrame(cases, "i int, p string, sb int, st int, n int")
    field = B.BitField.of(F.col("sb"), F.col("st"), F.col("n"))
    framed = frame.withColumn("f", B.frame(F.col("p")))
    why = B.skip_reason(F.col("f"), F.lit("0197"), field)
    got = framed.select(
        "i", why.alias("why"),
        F.when(why == "ok", B.bits_to_number(B.signal_bits(F.col("f"), field))).alias("v"),
    ).collect()
    for row in got:
        _, payload, sb, st, n = cases[row["i"]]
        want = walk(payload, sb, st, n)
        assert (None if row["v"] is None else int(row["v"])) == want, cases[row["i"]]
        assert (row["why"] == "ok") == (want is not None)


def test_notes_and_non_can_rows(spark):
    matched = spark.createDataFrame(
        [("speed", True, True, 1, "t", "01 97 01 12 34"), ("speed", True, False, None, None, None),
         ("speed", True, True, 2, "t", ""), ("other", False, True, 3, "t", "01 97 01 12 34")],
        "query_signal string, is_can boolean, matched boolean, line_no bigint, time string, payload string",
    )
    rows = decode_join(matched, spark.createDataFrame([SPEED], SCHEMA)).collect()
    assert sorted((r["note"] or "", r["match_value"] or 0.0) for r in rows) == [
        ("", 9.09375), ("payload is empty, skipping", 0.0), ("test_result is None, skipping", 0.0),
    ]


@pytest.mark.parametrize("number, text", [(407, "0197"), (0x12345, "12345"), (0, "0000")])
def test_frame_id_text(spark, number, text):
    assert spark.range(1).select(B.frame_id_text(F.lit(number)).alias("x")).first()["x"] == text


def test_plot_positions(spark):
    keys = F.array(F.lit(2).cast("bigint"), F.lit(9).cast("bigint"), F.lit(10).cast("bigint"))
    row = spark.range(1).select(
        B.choice_index(keys, F.lit(9.0)).alias("a"), B.choice_index(keys, F.lit(5)).alias("b"),
        B.unit_position(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("c"),
        B.unit_position(F.lit(50.0), F.lit(0.0), F.lit(10.0)).alias("d"),
        B.unit_position(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("e"),
        B.sorted_choice_keys(F.create_map(F.lit("10"), F.lit("x"), F.lit("9"), F.lit("y"))).alias("f"),
    ).first()
    assert tuple(row) == (1, 0, 0.5, 1.0, 0.0, [9, 10])


def test_digits_of_any_length(spark):
    rng = random.Random(11)
    sizes = [1, 29, 30, 58, 63, 64, 65, 87, 126, 127, 128, 200, 481]
    bits = [(i, "".join(rng.choice("01") for _ in range(n))) for i, n in enumerate(sizes * 3)]
    bits += [(100, "0" * 90), (101, "1" * 256), (102, "0" * 70 + "1" * 70), (103, "1" + "0" * 99)]
    got = spark.createDataFrame(bits, "i int, b string").select("i", B.bits_to_digits(F.col("b")).alias("d")).collect()
    assert {r["i"]: r["d"] for r in got} == {i: str(int(b, 2)) for i, b in bits}


def test_label_of_a_long_value(spark):
    from busweave.operators.decoding import decode_frames, with_frame

    value = (1 << 79) + 12345
    payload = "01 97 01 " + " ".join(f"{b:02x}" for b in value.to_bytes(10, "big"))
    rows = spark.createDataFrame([(payload,)], "payload string")
    pairs = with_frame(rows).selectExpr(
        "*", "'0197' AS msgid", "0 AS start_byte", "7 AS start_bit", "80 AS length", f"map('{value}', 'far') AS choices",
        "null AS minimum", "null AS maximum", "null AS offset", "null AS factor",
    )
    row = decode_frames(pairs).first()
    assert (row["signal_digits"], row["match_label"], row["signal_value"]) == (str(value), "far", None)
    assert row["match_value"] == float(value) and row["match_status"] == "matched"
