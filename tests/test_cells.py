import pytest
from pyspark.sql import functions as F

from busweave.functions import cells as S
from busweave.operators import catalogue as CAT

NB = "\u00a0"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", [
    (f"{NB}CanRxFrame_A{NB}", "_A"), (" IPC1 ", "IPC1"), ("CANRXFrame", ""), (f" {NB}", ""),
    ("CANRXFrame B", " B"), (f"A{NB}B", "AB"), (None, None),
])
def test_message_name(spark, raw, expected):
    assert one(spark, raw, S.clean_message_name) == expected


@pytest.mark.parametrize("raw, text, direction", [
    ("0x01", "0x01", "tx"), ("0x02", "0x02", "rx"), (f"{NB}0X02 ", "0x02", "rx"),
    ("2", "0x2", "unknown"), ("0x1", "0x1", "unknown"), ("2.0", "2.0", "unknown"),
    ("255", "0xff", "unknown"), (None, "", "unknown"),
])
def test_message_type(spark, raw, text, direction):
    assert one(spark, raw, S.normalise_msg_type) == text
    assert one(spark, raw, S.message_direction) == direction


def test_lenient_direction(spark):
    assert one(spark, "2", lambda c: S.message_direction(c, lenient=True)) == "rx"


@pytest.mark.parametrize("raw, expected", [
    ("0xC7", 199), (f" {NB}12", 12), ("192.0", None), ("abc", None), ("-5", -5), ("+5", 5),
    ("1_000", 1000), ("0x", None), ("", None), (None, None), ("0x0000000000000000c7", 199),
])
def test_text_id(spark, raw, expected):
    assert one(spark, raw, S.decimal_id) == expected


@pytest.mark.parametrize("raw, expected", [(199.9, 199), (-1.5, -1), (None, None)])
def test_number_id(spark, raw, expected):
    assert one(spark, raw, S.decimal_id_of_number, "double") == expected


@pytest.mark.parametrize("raw, expected", [
    ("sock[2]", ["sock[0]", "sock[1]"]), ("x[0]", []), ("a\nb", ["a", "b"]),
    (f"{NB}a [1]\r\n\r\n  b ", ["a[0]", "b"]), ("a[b]", ["a[b]"]), ("[3]", ["[3]"]),
])
def test_signal_cell(spark, raw, expected):
    assert one(spark, raw, S.expand_signal_cell) == expected


def sheet(spark, rows):
    schema = (
        "sheet string, row_no bigint, message_name string, component string, "
        "service_id string, method_id string, message_type string, signal_name string"
    )
    return spark.createDataFrame(
        [("Main", i, *r) for i, r in enumerate(rows)], schema
    )


ROWS = [
    (None, None, None, None, None, "lost"),
    ("A", "X", "0x10", "1", "0x01", "a1"),
    (None, None, None, None, None, "a2[2]"),
    ("B", f"CANNetwork{NB}", "2", None, "0x02", "b1"),
    (None, None, None, None, None, "b2"),
    (f" {NB}", "X", "3", "3", None, "c1"),
    (None, "X", "4", None, None, "c2"),
    ("A", "cannetwork", "5", "5", "1", None),
    (None, None, None, None, None, "d1"),
]


def test_catalogue_of_sheet(spark):
    got = CAT.build_catalogue(sheet(spark, ROWS)).orderBy("row_no").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("A", False, 16, 1, "tx"), ("B", True, 2, None, "rx"), ("A", False, 5, 5, "unknown"),
    ]
    counts = CAT.catalogue_counts(sheet(spark, ROWS)).first()
    assert tuple(counts) == (3, 6, 1)


def test_signal_lists_of_sheet(spark):
    got = CAT.signals_per_message(sheet(spark, ROWS)).orderBy("group_no").collect()
    assert [(r["group_no"], r["message_name"], r["signals"]) for r in got] == [
        (1, "A", ["a1", "a2[0]", "a2[1]"]), (7, "A", ["d1"]),
    ]


def test_message_without_signals_stays(spark):
    got = CAT.message_signals(sheet(spark, [("E", "X", None, None, None, "x[0]")])).collect()
    assert [(r["message_name"], r["signal"]) for r in got] == [("E", None)]
    nested = CAT.signals_per_message(sheet(spark, [("E", "X", None, None, None, None)])).first()
    assert nested["signals"] == []
