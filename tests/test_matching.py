from pyspark.sql import functions as F

from busweave.operators import (
    accuracy as ACC, decoding as DEC, dictionary as DIC, lookup as LOOK, matching as MAT,
)
from busweave.plans.analysis import analyze_properties, window_messages
from busweave.operators.series import all_points
from busweave.session import settle
from busweave.sources.records import flatten_signal_dictionary

CATALOGUE = (
    "row_no bigint, message_name string, is_can boolean, service_id bigint, method_id bigint, direction string"
)
FOUND = "place bigint, time string, type string, service_id bigint, method_id bigint, payload string"


def requests(spark, *names):
    return MAT.parse_properties(spark.createDataFrame([(n,) for n in names], "query_signal string"))


def test_catalogue_first_row_wins_without_underscores(spark):
    rows = [(2, "AB_C", True, 2, 2, "rx"), (1, "a_bc", False, 1, 1, "tx"), (3, "Z", True, 3, 3, "rx")]
    got = MAT.lookup_catalogue_message(
        requests(spark, "VHAL_Abc", "VHAL_none", "bad"), spark.createDataFrame(rows, CATALOGUE)
    )
    assert {(r["query_signal"], r["found"], r["message_name"]) for r in got.collect()} == {
        ("VHAL_Abc", True, "a_bc"), ("VHAL_none", False, None),
    }


def test_null_ids_match_and_misses_stay(spark):
    catalogue = spark.createDataFrame(
        [(1, "N", True, None, None, "rx"), (2, "M", True, 7, 8, "TX"), (3, "U", True, 7, 8, "unknown")],
        CATALOGUE,
    )
    messages = spark.createDataFrame(
        [(1, "t1", "rx", None, None, "aa"), (2, "t2", "tx", 7, 8, "bb"), (3, "t3", "tx", 7, None, "cc")],
        "line_no bigint, time string, type string, service_id bigint, method_id bigint, payload string",
    )
    looked = MAT.lookup_catalogue_message(requests(spark, "VHAL_n", "VHAL_m", "VHAL_u"), catalogue)
    got = MAT.match_messages(looked, messages).collect()
    assert {(r["query_signal"], r["matched"], r["line_no"]) for r in got} == {
        ("VHAL_n", True, 1), ("VHAL_m", True, 2), ("VHAL_u", False, None),
    }
    assert len(got) == 3


DOCUMENT = """{"rx": {"net_b": {"Ipc1": {"Other": {"msgid": "0001"}}},
  "net_a": {"IPC1": {"Speed": {"msgid": "0197", "start_byte": 0, "start_bit": 7, "length": 12,
    "choices": {}, "minimum": 0, "maximum": 127.96875, "offset": 0, "factor": 0.03125}}},
  "net_c": {"IPC1": {"speed": {"msgid": "9999"}}}}, "tx": {}}"""


def flat(spark):
    return flatten_signal_dictionary(
        spark.createDataFrame([(DOCUMENT,)], "value string"), F.col("value")
    )


def test_dictionary_rows(spark):
    rows = flat(spark).collect()
    assert [(r["namespace"], r["message"], r["signal"]) for r in rows] == [
        ("net_b", "Ipc1", "Other"), ("net_a", "IPC1", "Speed"), ("net_c", "IPC1", "speed"),
    ]
    names = DIC.format_signal_names(flat(spark))
    assert DIC.signal_count(names).first()["signals"] == 3
    assert "IPC1__Speed_rx_v" in [r["name"] for r in names.collect()]


def test_first_namespace_with_the_signal_wins(spark):
    got = DIC.lookup_signal_definition(requests(spark, "ipc1__SPEED_RX_v", "ipc1__Speed_tx_v"), flat(spark))
    assert {(r["query_signal"], r["namespace"], r["msgid"]) for r in got.collect()} == {
        ("ipc1__SPEED_RX_v", "net_a", "0197"), ("ipc1__Speed_tx_v", None, None),
    }


def test_routes(spark):
    catalogue = spark.createDataFrame(
        [(1, "IPC1", True, 1, 1, "rx"), (2, "Sock_A", False, 2, 2, "rx"), (3, "Lone", False, 3, 3, "rx")],
        CATALOGUE,
    )
    noncan = spark.createDataFrame(
        [(1, "SOCK_A", ["s[0]", "s[1]"]), (2, "sock_a", ["late"]), (3, "Socka", ["no"])],
        "row_no bigint, message_name string, signals array<string>",
    )
    looked = MAT.lookup_catalogue_message(requests(
        spark, "VHAL_IPC1", "IPC1__Speed_rx_v", "IPC1__Nope_rx_v", "VHAL_Sock_A", "Sock_A__x_rx_v",
        "VHAL_SockA", "VHAL_Lone", "VHAL_gone",
    ), catalogue)
    got = {r["query_signal"]: r for r in MAT.route_definitions(looked, noncan, flat(spark)).collect()}
    assert got["VHAL_IPC1"]["note"].startswith("isCAN is true")
    assert (got["IPC1__Speed_rx_v"]["source"], got["IPC1__Speed_rx_v"]["msgid"]) == ("definition", "0197")
    assert got["IPC1__Nope_rx_v"]["error"] == "not found"
    assert got["VHAL_Sock_A"]["signals"] == ["s[0]", "s[1]"]
    assert got["Sock_A__x_rx_v"]["signals"] == ["s[0]", "s[1]"]
    # the list lookup keeps underscores, the catalogue lookup does not
    assert got["VHAL_SockA"]["signals"] == ["no"]
    assert got["VHAL_Lone"]["error"] == "not found"
    assert got["VHAL_gone"]["error"] == "'gone' not found in the message catalogue"


def test_whole_analysis(spark):
    line = "06-01 17:50:0{}.000 1 1 D s: SomeipCOmm :: RX Message [0/1]:service:c7 ,Method:1,payload:01 97 01 {} 34 "
    texts = [line.format(0, "12"), line.format(1, "00"), "  more", line.format(9, "12")]
    lines = spark.createDataFrame(
        [(i, "f", t) for i, t in enumerate(texts)], "line_no bigint, file_path string, value string"
    )
    from busweave.functions.text import log_timestamp

    timed = lines.withColumn("ts", log_timestamp(F.col("value")))
    for strict in (False, True):
        window = window_messages(
            timed, F.expr("timestamp_ntz'1900-06-01 17:50:01'"), strict=strict, key="line_no"
        )
        catalogue = spark.createDataFrame([(1, "IPC1", True, 0xC7, 1, "rx")], CATALOGUE)
        noncan = spark.createDataFrame([], "row_no bigint, message_name string, signals array<string>")
        properties = spark.createDataFrame([("IPC1__Speed_rx_v",), ("nonsense",)], "query_signal string")
        result = analyze_properties(properties, window, catalogue, noncan, flat(spark))
        values = sorted(r["match_value"] for r in result.decoded.collect())
        assert values == [0x003 * 0.03125, 0x123 * 0.03125]
        assert [r["query_signal"] for r in result.rejected.collect()] == ["nonsense"]
        assert all_points(result.decoded).count() == 2


def test_bus_dictionary_last_message_wins(spark):
    messages = spark.createDataFrame(
        [(1, "F", 0x1FFFF, ["n"], ["r"]), (2, "F", 0x10, ["n"], []), (3, "G", 0x11, None, ["n"])],
        "message_no bigint, name string, frame_id bigint, senders array<string>, receivers array<string>",
    )
    signals = spark.createDataFrame(
        [(1, 1, "old", 12, 3, None), (2, 1, "new", 17, 4, {"1": " on "})],
        "message_no bigint, signal_no bigint, signal string, start int, length int, choices map<string,string>",
    )
    got = DIC.build_signal_dictionary(messages, signals).collect()
    assert {(r["direction"], r["namespace"], r["message"], r["signal"], r["msgid"], r["start_byte"], r["start_bit"])
            for r in got} == {
        ("tx", "n", "F", "new", "0010", 2, 1), ("rx", "r", "F", "old", "1FFFF", 1, 4),
        ("rx", "n", "G", None, "0011", None, None),
    }
    nested = {(r["direction"], r["namespace"]): r["signals"] for r in DIC.nest_message_signals(
        DIC.build_signal_dictionary(messages, signals)).collect()}
    assert nested[("rx", "n")] == {} and nested[("tx", "n")]["new"]["choices"] == {"1": "on"}
    assert {r["node"] for r in DIC.distinct_nodes(messages).collect()} == {"n", "r"}


def test_search(spark):
    names = spark.createDataFrame([(i, f"N{i}__Speed") for i in range(150)], "line_key bigint, name string")
    got = DIC.search_signal_names(names, " SPEED ", 100).collect()
    assert [r["line_key"] for r in got] == list(range(100))
    assert DIC.search_signal_names(names, "  ", 100).count() == 0


def test_first_and_last(spark):
    frame = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 3, "z")], "k string, n int, v string")
    pick = lambda fn: {(r["k"], r["n"], r["v"]) for r in fn(frame, ["k"], "n").collect()}
    assert pick(LOOK.first_match_per_key) == {("a", 1, None), ("b", 3, "z")}
    assert pick(LOOK.last_match_per_key) == {("a", 2, "x"), ("b", 3, "z")}


def test_accuracy_levels(spark):
    truth = spark.createDataFrame(
        [(1, "t1", "rx", 1, 1, "aa bb"), (2, "t2", "rx", 1, 1, "aa"), (3, "t3", "tx", 1, 1, "aa"),
         (4, "t4", "rx", 1, 1, "aa"), (5, "t5", "rx", 1, 1, "aa")],
        "line_no bigint, time string, type string, service_id bigint, method_id bigint, payload string",
    )
    found = spark.createDataFrame(
        [(1, "t1", "RX", 1, 1, "zz"), (2, "t1", "rx", 1, 1, " AA  bb "), (3, "t2", "rx", 1, 1, "ab"),
         (4, "t3", "rx", 1, 1, "aa"), (5, "t3", "rx", 1, 1, "aa"), (6, "t4", "rx", None, 1, "aa"),
         (7, "", "rx", 1, 1, "aa")],
        FOUND,
    )
    report = ACC.accuracy_report(truth, found).first()
    assert tuple(report) == (5, 1, 1, 2, 1, 20.0)
    detail = ACC.accuracy_mismatch_detail(truth, found).collect()
    assert {(r["time"], r["found_rows"], r["type_ok"], r["service_id_ok"], r["payload_ok"]) for r in detail} == {
        ("t3", 2, False, True, True), ("t4", 1, True, False, True),
    }
    assert [r["line_no"] for r in ACC.accuracy_missing(truth, found).collect()] == [5]
    empty = ACC.accuracy_report(truth.limit(0), found).first()
    assert empty["accuracy"] == 0.0


def small_file(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.read.schema(schema).parquet(f"{tmp_path}/{name}")


def test_requests_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """A file of a few bytes may hold, or be exploded to, millions of requests."""
    names = small_file(spark, tmp_path, "names", [("VHAL_n",), ("N__s_rx_v",)], "query_signal string")
    catalogue = small_file(spark, tmp_path, "catalogue", [(1, "N", True, 7, 8, "rx")], CATALOGUE)
    schema = "line_no bigint, time string, type string, service_id bigint, method_id bigint, payload string"
    messages = small_file(spark, tmp_path, "messages", [(1, "t1", "rx", 7, 8, "aa")], schema)
    looked = MAT.lookup_catalogue_message(MAT.parse_properties(names), catalogue)
    hits = MAT.matched_messages(looked, messages)
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    found = DIC.lookup_signal_definition(looked, flat(spark))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["query_signal"] for r in hits.collect()) == ["N__s_rx_v", "VHAL_n"]


def test_rows_are_dealt_out_before_a_task_sorts_them(spark):
    """A scan task may hold any number of rows, a hot key too: they meet one per key and task."""
    frame = spark.range(0, 5000, 1, 1).selectExpr("id % 3 AS k", "id AS n", "concat('v', id) AS v")
    picked = LOOK.first_match_per_key(frame, ["k"], "n")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.rindex("Exchange hashpartitioning(k") > plan.rindex("partial_min_by")
    assert sorted(tuple(r) for r in picked.collect()) == [(0, 0, "v0"), (1, 1, "v1"), (2, 2, "v2")]


def test_definitions_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """Requests and their definitions meet by a merge; only distinct ids may be broadcast."""
    names = small_file(spark, tmp_path, "names", [("N__s_rx_v",)], "query_signal string")
    catalogue = small_file(spark, tmp_path, "catalogue", [(1, "N", True, 7, 8, "rx")], CATALOGUE)
    schema = "line_no bigint, time string, type string, service_id bigint, method_id bigint, payload string"
    messages = small_file(spark, tmp_path, "messages", [(1, "t1", "rx", 7, 8, None)], schema)
    looked = settle(MAT.lookup_catalogue_message(MAT.parse_properties(names), catalogue))
    definitions = settle(MAT.route_definitions(looked, flat(spark).select(
        F.lit("none").alias("message_name"), F.lit(1).alias("row_no"), F.array(F.lit("s")).alias("signals")
    ), flat(spark)))
    decoded = DEC.decode_requests(looked, messages, definitions)
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert plan.count("SortMergeJoin") == 3 and all("LeftAnti" in line for line in joins)
    assert [(r["query_signal"], r["note"]) for r in decoded.collect()] == [("N__s_rx_v", DEC.NOTE_NO_PAYLOAD)]


def test_results_per_property_broadcast_no_requests(spark, tmp_path):
    """Requests of small files meet catalogue and messages by merges, repeated ones and misses too."""
    asked = [("VHAL_n",), ("N__s_rx_v",), ("N__s_rx_v",), ("VHAL_m",), ("VHAL_absent",), ("bad",)]
    names = small_file(spark, tmp_path, "names", asked, "query_signal string")
    kinds = [(1, "N", True, 7, 8, "rx"), (2, "M", True, 7, 9, "rx")]
    catalogue = small_file(spark, tmp_path, "catalogue", kinds, CATALOGUE)
    schema = "line_no bigint, time string, type string, service_id bigint, method_id bigint, payload string"
    heard = [(i, "t", "rx", 7, 8, "aa") for i in range(3)]
    messages = small_file(spark, tmp_path, "messages", heard, schema)
    looked = MAT.lookup_catalogue_message(MAT.parse_properties(names), catalogue)
    counts = MAT.match_messages(looked, messages).groupBy("query_signal").agg(
        F.count("*").alias("rows"), F.count_if("matched").alias("matches")
    )
    plan = counts._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert all("LeftAnti" in line for line in joins if "Broadcast" in line) and "SortMergeJoin" in plan
    assert sorted(map(tuple, counts.collect())) == [("N__s_rx_v", 6, 6), ("VHAL_m", 1, 0), ("VHAL_n", 3, 3)]
