from datetime import datetime

import pytest
from pyspark.sql import functions as F

from busweave.functions import text as X
from busweave.operators.matching import parse_properties
from busweave.operators.messages import extract_messages, filter_message_lines, with_message

RX = (
    "06-01 17:50:04.803   612   634 D vehicle-service: SomeipCOmm :: RX Message "
    "[0/1f]:service:c7 ,Method:80e5,payload:01 C6  01 ff "
)
TX = (
    "06-01 17:50:05.1   612   634 D vehicle-service: TX Message SomeipComm::send  : "
    "service:193,method:4, response Payload: 0A 0b "
)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "value string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("line, expected", [
    ("06-01 17:50:04.803 x", datetime(1900, 6, 1, 17, 50, 4, 803000)),
    ("  06-01   17:50:04.123456 x", datetime(1900, 6, 1, 17, 50, 4, 123456)),
    ("06-01 17:50:04.1234567 x", None),
    ("06-01 17:50:04 x", None),
    ("02-29 10:00:00.000 x", None),
    ("13-01 10:00:00.000 x", None),
    ("06-01 10:00:60.000 x", None),
    ("x 06-01 10:00:00.000", None),
])
def test_line_time(spark, line, expected):
    assert one(spark, line, X.log_timestamp(F.col("value"))) == expected


def test_leap_day_needs_leap_anchor(spark):
    got = one(spark, "02-29 10:00:00.000 x", X.log_timestamp(F.col("value"), 2000))
    assert got == datetime(2000, 2, 29, 10)


@pytest.mark.parametrize("text, expected", [
    (" 06-01 17:50:04.803 ", datetime(1900, 6, 1, 17, 50, 4, 803000)),
    ("06-01 17:50:04", datetime(1900, 6, 1, 17, 50, 4)),
    ("6-1 7:5:4.5", datetime(1900, 6, 1, 7, 5, 4, 500000)),
    ("noon", None),
])
def test_target_time(spark, text, expected):
    assert one(spark, text, X.target_timestamp(F.col("value"))) == expected


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no bigint, value string")


def test_five_fields(spark):
    rows = extract_messages(lines(spark, RX, TX, "06-01 17:50:04.803 other")).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [
        (0, "06-01 17:50:04.803", "rx", 0xC7, 0x80E5, "01 c6 01 ff"),
        (1, "06-01 17:50:05.1", "tx", 193, 4, "0a 0b"),
    ]


def test_pattern_ignores_case_and_searches_but_prefilter_does_not(spark):
    odd = "junk " + RX.replace("SomeipCOmm", "SOMEIPCOMM").replace("Method", "METHOD")
    frame = lines(spark, odd)
    assert extract_messages(frame).count() == 1
    assert filter_message_lines(frame).count() == 0


def test_both_forms_on_a_line_read_as_received(spark):
    row = extract_messages(lines(spark, TX + RX)).first()
    assert row["type"] == "rx"


def test_bad_ids_do_not_become_numbers(spark):
    bad = RX.replace("service:c7", "service:zz")
    assert extract_messages(lines(spark, bad)).count() == 0
    huge = extract_messages(lines(spark, RX.replace("service:c7", "service:" + "f" * 20))).first()
    assert huge["service_id"] is None and huge["method_id"] == 0x80E5


def test_separator_in_payload_stays(spark):
    row = extract_messages(lines(spark, RX + "\u0001x")).first()
    assert row["payload"] == "01 c6 01 ff \u0001x"


def test_with_message_keeps_other_lines(spark):
    rows = with_message(lines(spark, RX, "other")).orderBy("line_no").collect()
    assert rows[0]["message"]["type"] == "rx" and rows[1]["message"] is None


@pytest.mark.parametrize("name, expected", [
    ("VHAL_a__b_rx_v", ("message", "a__b_rx_v", None, None, None)),
    ("vhal_X", ("message", "X", None, None, None)),
    ("A___B_RX_v", ("signal", "A", "_B", "rx", None)),
    ("IPC1__VehSpd_tx_v", ("signal", "IPC1", "VehSpd", "tx", None)),
    ("a__b__c_rx_v", ("signal", "a", "b__c", "rx", None)),
    ("foo", (None, None, None, None, "unrecognised property name")),
    ("VHAL_", (None, None, None, None, "unrecognised property name")),
])
def test_property_names(spark, name, expected):
    frame = spark.createDataFrame([(name,)], "query_signal string")
    assert tuple(parse_properties(frame).first())[1:] == expected


@pytest.mark.parametrize("name, expected", [
    ("a__b__c", ("a", "b__c")), ("plain", ("", "plain")), ("__x", ("", "x")),
])
def test_signal_name_parts(spark, name, expected):
    got = spark.createDataFrame([(name,)], "value string").select(
        X.signal_owner(F.col("value")), X.signal_label(F.col("value"))
    ).first()
    assert tuple(got) == expected
