import json

from pyspark.sql import functions as F

from busweave.session import scratch_path
from busweave.sources import logs, records, sheets, sinks
from busweave.streaming import follow

LINE = "06-01 17:50:0{}.000 D s: SomeipCOmm :: RX Message [0/1]:service:c7 ,Method:1,payload:01 97 01 12 34 "


def test_log_lines_keep_order_and_replace_bad_bytes(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"06-01 17:50:04.803 one\r\n  bad \xff byte\n\nlast")
    rows = sorted(logs.read_log_lines(spark, str(path)).collect(), key=lambda r: r["line_key"])
    assert [r["value"] for r in rows] == ["06-01 17:50:04.803 one", "  bad � byte", "", "last"]
    assert [r["ts"] is None for r in rows] == [False, True, True, True]
    assert logs.read_nonblank_lines(spark, str(path)).count() == 3


def test_line_order_over_several_blocks(spark, tmp_path):
    for name in ("b.log", "a.log"):
        (tmp_path / name).write_text("".join(f"{name} {i:05d} {'x' * 50}\n" for i in range(3000)))
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "20000")
    rows = logs.read_log_lines(spark, str(tmp_path)).orderBy("line_key").collect()
    spark.conf.unset(key)
    values = [r["value"] for r in rows]
    assert len(values) == 6000 and values == sorted(values)


def test_json_documents(spark, tmp_path):
    (tmp_path / "catalogue.json").write_text(json.dumps([
        {"messagename": "A", "isCAN": True, "service id": 1, "method id": None, "direction": "rx"},
        {"messagename": "B", "service id": 2, "method id": 3, "direction": "tx"},
    ], indent=2))
    rows = records.read_catalogue(spark, str(tmp_path / "catalogue.json")).orderBy("row_no").collect()
    assert [tuple(r)[1:] for r in rows] == [("A", True, 1, None, "rx"), ("B", False, 2, 3, "tx")]
    (tmp_path / "lists.json").write_text(json.dumps([{"messageName": "S", "signals": ["x", "y"]}]))
    assert records.read_noncan_signals(spark, str(tmp_path / "lists.json")).first()["signals"] == ["x", "y"]
    (tmp_path / "dictionary.json").write_text(json.dumps(
        {"rx": {"n": {"M": {"s": {"msgid": "0001", "length": 3, "choices": {"1": "on"}}}}}, "tx": {}}, indent=4))
    row = records.read_signal_dictionary(spark, str(tmp_path / "dictionary.json")).first()
    assert (row["signal"], row["length"], row["choices"], row["factor"]) == ("s", 3, {"1": "on"}, None)


def test_sheet_by_position(spark, tmp_path):
    cells = [f"c{i}" for i in range(29)]
    text = ",".join(f"head {i}" for i in range(30)) + "\n" + ",".join(cells + ["7"]) + "\n"
    cells[14], cells[28] = "", '"a\nb"'
    text += ",".join(cells + ["8"]) + "\n"
    (tmp_path / "sheet.csv").write_text(text)
    rows = sheets.read_catalogue_rows(spark, str(tmp_path / "sheet.csv"), 29).orderBy("row_no").collect()
    assert tuple(rows[0])[1:] == (7, "c14", "c17", "c24", "c25", "c26", "c28")
    assert (rows[1]["message_name"], rows[1]["signal_name"]) == (None, "a\nb")


def test_message_table_prunes_days_and_ids(spark):
    path = scratch_path(spark, "table")
    rows = [(f"0{1 + i % 2}-01 10:00:00.000", "rx", i % 5, 1, "aa") for i in range(100)]
    frame = spark.createDataFrame(rows, "time string, type string, service_id bigint, method_id bigint, payload string")
    sinks.write_message_table(frame, path)
    back = spark.read.parquet(path).filter("day = '01-01' AND service_id = 3").select("payload")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(service_id,3)" in plan
    assert back.count() == 10


def test_time_order_over_files(spark):
    path = scratch_path(spark, "ordered")
    rows = spark.range(500).select(
        F.format_string("06-01 00:00:%02d.000", F.pmod(F.col("id") * 7, F.lit(3))).alias("time"), "id")
    sinks.write_time_ordered(rows, path, ties=("id",))
    back = spark.read.schema(rows.schema).json(path).withColumn("file", F.input_file_name()).collect()
    files = {}
    for row in back:
        files.setdefault(row["file"], []).append((row["time"], row["id"]))
    joined = [row for name in sorted(files) for row in files[name]]
    assert len(joined) == 500 and joined == sorted(joined)


def test_following_a_folder(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    definitions = spark.createDataFrame(
        [("speed", "0197", 0, 7, 12, None, 0.0, 200.0, 0.0, 0.03125)],
        "query_signal string, msgid string, start_byte int, start_bit int, length int, "
        "choices map<string,string>, minimum double, maximum double, offset double, factor double",
    )

    def run():
        rows = follow.follow_decoded(follow.follow_log_lines(spark, str(folder)), definitions)
        rows = rows.select("time", "match_value")
        follow.append_json(rows, str(out), str(state), available_now=True).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(rows.schema).json(str(out)).collect())

    (folder / "a.log").write_text(LINE.format(1) + "\nother\n")
    assert run() == [("06-01 17:50:01.000", 9.09375)]
    (folder / "b.log").write_text(LINE.format(2) + "\n")
    assert run() == [("06-01 17:50:01.000", 9.09375), ("06-01 17:50:02.000", 9.09375)]
