import json

from busweave import jobs
from busweave.session import scratch_path

RX = "06-01 17:50:0{}.000 D s: SomeipCOmm :: RX Message [0/1]:service:c7 ,Method:1,payload:01 97 01 {} 34 "


def rows(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))
    return str(path)


def log(tmp_path):
    texts = ["early", RX.format(1, "12"), "  more", RX.format(2, "12"), "", RX.format(3, "00"),
             "06-01 17:59:00.000 late", RX.format(4, "00")]
    return write(tmp_path / "log.txt", "\n".join(texts) + "\n")


def test_analyze(spark, tmp_path):
    out = scratch_path(spark, "job")
    definition = {"msgid": "0197", "start_byte": 0, "start_bit": 7, "length": 12, "choices": {},
                  "minimum": 0, "maximum": 127.96875, "offset": 0, "factor": 0.03125}
    jobs.main([
        "analyze", "--log", log(tmp_path), "--time", "06-01 17:50:02", "--out", out,
        "--properties", write(tmp_path / "p.txt", "IPC1__Speed_rx_v\nVHAL_IPC1\nodd\n"),
        "--catalogue", write(tmp_path / "c.json", [
            {"messagename": "IPC1", "isCAN": True, "service id": 199, "method id": 1, "direction": "rx"}]),
        "--lists", write(tmp_path / "l.json", [{"messageName": "Sock", "signals": ["a"]}]),
        "--dictionary", write(tmp_path / "d.json", {"rx": {"n": {"IPC1": {"Speed": definition}}}, "tx": {}}),
    ], spark)
    window = [r["value"] for r in spark.read.text(f"{out}/window").collect()]
    assert window == [RX.format(1, "12"), "  more", RX.format(2, "12"), "", RX.format(3, "00")]
    decoded = rows(spark, f"{out}/decoded")
    assert sorted(r["match_value"] for r in decoded) == [3 * 0.03125, 9.09375, 9.09375]
    matches = rows(spark, f"{out}/matches")
    assert len(matches) == 6 and matches[0]["test_result"]["type"] == "rx"
    notes = {r["query_signal"]: r.get("note") for r in rows(spark, f"{out}/definitions")}
    assert notes["VHAL_IPC1"] and notes["IPC1__Speed_rx_v"] is None
    assert [r["query_signal"] for r in rows(spark, f"{out}/rejected")] == ["odd"]
    steps = sorted((r["ts"][-9:-4], r["until"][-9:-4], r["value"]) for r in rows(spark, f"{out}/steps"))
    assert [s[2] for s in steps] == [9.09375, 3 * 0.03125]


def test_references_feed_analyze(spark, tmp_path):
    out = scratch_path(spark, "job")
    cells = [[""] * 29 for _ in range(3)]
    for row, (name, component, signal) in zip(cells, [("A", "X", "s[2]"), ("", "", "t"), ("B", "CANNetwork", "u")]):
        row[14], row[17], row[24], row[25], row[26], row[28] = name, component, "0xC7", "1", "0x02", signal
    cells[1][24] = ""
    text = ",".join(f"h{i}" for i in range(30)) + "\n"
    text += "".join(",".join([*row, str(i)]) + "\n" for i, row in enumerate(cells))
    jobs.main(["references", "--sheet", write(tmp_path / "s.csv", text), "--out", out], spark)
    assert rows(spark, f"{out}/catalogue") == [
        {"messagename": "A", "isCAN": False, "service id": 199, "method id": 1, "direction": "rx"},
        {"messagename": "B", "isCAN": True, "service id": 199, "method id": 1, "direction": "rx"},
    ]
    assert rows(spark, f"{out}/lists") == [{"messageName": "A", "signals": ["s[0]", "s[1]", "t"]}]
    assert rows(spark, f"{out}/counts") == [{"parsed": 2, "skipped": 1, "skipped_can": 1}]


def test_accuracy(spark, tmp_path):
    good = {"Timestamp": "06-01 17:50:01.000", "type": "RX", "serviceId": 199, "methodId": 1,
            "payload": "01 97  01 12 34"}
    records = [{**good, "payload": "00"}, good, {**good, "time": "06-01 17:50:02.000", "serviceId": "199"}]
    for flag, found in (
        ([], write(tmp_path / "f.json", records)),
        (["--json-lines"], write(tmp_path / "f.jsonl", "\n".join(map(json.dumps, records)))),
    ):
        out = scratch_path(spark, "job")
        jobs.main(["score_accuracy", "--log", log(tmp_path), "--found", found, "--out", out, *flag], spark)
        (report,) = rows(spark, f"{out}/report")
        assert report == {"truth_rows": 4, "exact_rows": 1, "payload_rows": 0, "identity_rows": 1,
                          "missing_rows": 2, "accuracy": 25.0}
        assert len(rows(spark, f"{out}/missing")) == 2


def test_dictionary_and_training_set(spark, tmp_path):
    out = scratch_path(spark, "job")
    spark.createDataFrame([(1, "F", 0x10, ["n"], ["r"])],
        "message_no bigint, name string, frame_id bigint, senders array<string>, receivers array<string>"
    ).write.parquet(f"{out}/m")
    spark.createDataFrame([(1, 1, "s", 12, 3, {"1": "on"})],
        "message_no bigint, signal_no bigint, signal string, start int, length int, choices map<string,string>"
    ).write.parquet(f"{out}/s")
    jobs.main(["dictionary", "--messages", f"{out}/m", "--signals", f"{out}/s", "--out", out], spark)
    names = {r["value"] for r in spark.read.text(f"{out}/names").collect()}
    assert names == {"F__s_tx_v", "F__s_rx_v"}
    jobs.main(["training_set", "--log", log(tmp_path), "--out", out], spark)
    types = {r["sample_type"]: r["samples"] for r in rows(spark, f"{out}/audit-types")}
    assert types == {"rx": 4, "tx": 0, "not_someip": 3, "parse_error": 0}


def test_quota_training_set_and_stable_split(spark, tmp_path):
    out = scratch_path(spark, "job")
    jobs.main(["training_set", "--quotas", "--log", log(tmp_path), "--out", out], spark)
    types = {r["sample_type"]: r["samples"] for r in rows(spark, f"{out}/audit-types")}
    assert types == {"rx": 4, "tx": 0, "not_someip": 3, "parse_error": 0}
    again = scratch_path(spark, "job")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        jobs.main(["training_set", "--log", log(tmp_path), "--out", again], spark)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    read = lambda path: sorted((r.split, r.text) for r in spark.read.json(path).collect())
    assert read(f"{out}/samples") == read(f"{again}/samples")


def test_ingest_appends_what_is_new(spark, tmp_path):
    from busweave.sources.ingest import read_ingested

    folder, out = tmp_path / "logs", f"file://{tmp_path}/table"
    folder.mkdir()
    for text in ("", RX.format(1, "12") + "\nopen", RX.format(1, "12") + "\nopen\n" + RX.format(2, "12") + "\n"):
        (folder / "a.log").write_text(text)
        jobs.main(["ingest", "--folder", str(folder), "--out", out], spark)
    got = read_ingested(spark, out).orderBy("line_key").select("time", "batch").collect()
    assert [(r["time"][-6:], r["batch"]) for r in got] == [("01.000", 1), ("02.000", 2)]
