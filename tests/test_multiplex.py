"""Byte order, sign and multiplexing against a walk over the bits."""

import random

import pytest
from busweave.functions import frames as B
from busweave.operators import multiplex
from pyspark.sql import functions as F

DEFINITION = (
    "query_signal string, msgid string, start_byte int, start_bit int, length int, choices map<string,string>, "
    "factor double, offset double, little_endian boolean, is_signed boolean, is_multiplexor boolean, mux_value int"
)


def walk(data, start_byte, start_bit, length, little):
    """Bits of the field, most significant first, or None when bytes run out."""
    at, bit, out = 3 + start_byte, start_bit, []
    for _ in range(length):
        if at >= len(data):
            return None
        out.append(data[at] >> bit & 1)
        if little:
            at, bit = (at, bit + 1) if bit < 7 else (at + 1, 0)
        else:
            at, bit = (at, bit - 1) if bit else (at + 1, 7)
    return "".join(map(str, reversed(out) if little else out))


def signed_value(bits, signed):
    value = int(bits, 2)
    return value - (1 << len(bits)) if signed and bits[0] == "1" else value


def test_both_orders_and_signs(spark):
    rng = random.Random(17)
    cases = []
    for i in range(1200):
        data = [1, 0x97, 1] + [rng.choice([0, 255, rng.randrange(256)]) for _ in range(rng.randint(1, 24))]
        cases.append((
            i, " ".join(f"{b:02x}" for b in data), rng.randint(0, 6), rng.randint(0, 7),
            rng.choice([1, 7, 8, 9, 63, 64, 65, 128, rng.randint(1, 128)]), rng.random() < 0.5, rng.random() < 0.5,
        ))
    frame = spark.createDataFrame(cases, "i int, p string, sb int, st int, n int, le boolean, s boolean")
    field = B.BitField.of(F.col("sb"), F.col("st"), F.col("n"), F.col("le"))
    framed = frame.withColumn("f", B.frame(F.col("p"))).withColumn("why", B.skip_reason(F.col("f"), F.lit("0197"), field))
    framed = framed.withColumn("bits", F.when(F.col("why") == "ok", B.signal_bits(F.col("f"), field)))
    got = {
        r["i"]: r for r in framed.select(
            "i", "why", "bits", B.signed_number(F.col("bits"), F.col("s")).alias("v"), B.signed_double(F.col("bits"), F.col("s")).alias("d")
        ).collect()
    }
    seen = 0
    for i, p, sb, st, n, le, s in cases:
        bits = walk(bytes.fromhex(p.replace(" ", "")), sb, st, n, le)
        assert got[i]["bits"] == bits and (bits is not None) == (got[i]["why"] == "ok")
        if bits:
            seen += 1
            value = signed_value(bits, s)
            assert got[i]["v"] == (value if -(1 << 64) <= value < 1 << 64 else None)
            assert got[i]["d"] == pytest.approx(float(value), rel=1e-12)
    assert seen > 500


def definition(name, start, bit, length, little=None, signed=None, mux=None, value=None, choices=None, msgid="0197"):
    return (name, msgid, start, bit, length, choices or {}, 0.5 if not choices else None, 1.0, little, signed, mux, value)


@pytest.fixture(scope="module")
def definitions(spark):
    return spark.createDataFrame([
        definition("sel", 0, 0, 4, True, None, True, None, {"1": "one", "2": "two"}),
        definition("always", 1, 7, 8, None, True),
        definition("one_a", 2, 0, 12, True, True, None, 1),
        definition("one_b", 4, 7, 8, False, None, False, 1),
        definition("two", 2, 7, 16, None, True, None, 2),
        definition("other", 0, 7, 8, msgid="0198"),
    ], DEFINITION)


def test_two_stages(spark, definitions):
    payloads = [(0, "01 97 01 f1 ff 34 f2 7f"), (1, "01 97 01 02 80 80 01"), (2, "01 97 01 05 01 02 03 04"), (3, "01 98 01 10"), (4, "01 97 01"), (5, "01 97 00 01 02 03 04 05"), (6, None)]
    rows = spark.createDataFrame(payloads, "line_no long, payload string")
    got = {(r["line_no"], r["query_signal"]): r for r in multiplex.decode_fields(rows, definitions).collect()}
    number = {k: int(r["number"]) for k, r in got.items()}
    assert number == {
        (0, "sel"): 1, (0, "always"): -1, (0, "one_a"): 0x234, (0, "one_b"): 0x7F,
        (1, "sel"): 2, (1, "always"): -128, (1, "two"): 0x8001 - 0x10000,
        (2, "sel"): 5, (2, "always"): 1, (3, "other"): 16,
    }
    assert got[0, "sel"]["match_label"] == "one" and got[1, "two"]["physical_value"] == (0x8001 - 0x10000) * 0.5 + 1


def test_plan_joins_on_id_and_value(spark, definitions):
    rows = spark.createDataFrame([(0, "01 97 01 f1 ff")], "line_no long, payload string")
    plan = multiplex.decode_fields(rows, definitions)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
