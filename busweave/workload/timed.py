"""Queries over time: streams with keyed state, sessions, overlaps, years; rollups, comparisons, document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from busweave import schemas
from busweave.functions.frames import payload_bytes
from busweave.functions.text import log_timestamp
from busweave.operators import (
    accuracy as ACC, dictionary as DIC, digests as DIG, multiplex as MUX, names as NAM, overlap as OVE, reconcile as REC, rollups as ROL,
    series as SER, sessions as SES, windowing as WIN, years as YEA,
)
from busweave.session import fixed_rows, scratch_path
from busweave.sources import ingest as ING, records, sinks
from busweave.streaming import states as STA
from busweave.workload import bindings as D
from busweave.workload.oracle import _compose

QUERIES: dict = {}
KEYS = ("file_path", "query_signal")
GAP, SILENCE, BURST, RATE = 1800, 7200, 2, 0.0006


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each log for itself."""
    return SER.all_points(D.decoded(spark, sf_dir), scope=("file_path",))


def _followed(spark: SparkSession, rows: DataFrame, tick: dict, label: str) -> DataFrame:
    """Rows as a stream of files, completed by a tick two days after the last time."""
    folder = scratch_path(spark, label)
    rows.write.parquet(folder)
    last = spark.read.schema(rows.schema).parquet(folder).agg(F.max("ts").alias("ts"))
    end = last.select(*[
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias(c) if c == "ts"
        else F.lit(tick.get(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns
    ])
    end.filter("ts IS NOT NULL").write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def _to_end(rows: DataFrame, label: str) -> DataFrame:
    """What the stream has emitted at the end of its input."""
    spark = rows.sparkSession
    out, checkpoint = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-state")
    STA.append_table(rows, out, checkpoint, available_now=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


_TICK = {"file_path": "end", "query_signal": "end"}


@query
def stream_change_points(spark, sf_dir):
    points = _followed(spark, _points(spark, sf_dir), _TICK, "followed-points")
    return _to_end(STA.follow_change_points(points, KEYS), "changes")


@query
def stream_step_intervals(spark, sf_dir):
    """Steps that end where a signal falls silent."""
    points = _followed(spark, _points(spark, sf_dir), _TICK, "followed-points")
    return _to_end(STA.follow_steps(points, KEYS, silence=SILENCE), "steps")


@query
def stream_asof_value(spark, sf_dir):
    """Every signal of every log at the first line of every day."""
    points = _points(spark, sf_dir).select(
        F.concat_ws("/", *KEYS).alias("query_signal"), "ts", "line_no", "value"
    )
    signal = F.concat(F.lit("Bus__"), F.col("signal"), F.lit("_rx_v"))
    logs = F.explode(F.array(*[F.lit(f"log_{i}") for i in range(4)])).alias("log")
    asked = D.with_signals(D.daily_targets(spark, sf_dir)).filter("sig_no <> 6").select("*", logs)
    probes = asked.select(
        F.replace("target_id", F.lit("-"), F.lit("")).cast("bigint").alias("probe_id"),
        F.concat_ws("/", "log", signal).alias("query_signal"),
        F.col("target_ts").alias("ts"),
    )
    tick = {"query_signal": "end"}
    return _to_end(
        STA.follow_asof(_followed(spark, points, tick, "followed-points"), _followed(spark, probes, tick, "followed-probes")),
        "asof",
    )


@query
def stream_sessions(spark, sf_dir):
    points = _followed(spark, _points(spark, sf_dir).select(*KEYS, "ts"), _TICK, "followed-points")
    return _to_end(STA.follow_sessions(points, KEYS, gap=GAP), "sessions").filter("query_signal <> 'end'")


@query
def signal_sessions(spark, sf_dir):
    return SES.sessions(_points(spark, sf_dir), KEYS, GAP)


@query
def signal_silences(spark, sf_dir):
    return SES.silences(SES.sessions(_points(spark, sf_dir), KEYS, GAP), KEYS)


@query
def signal_bursts(spark, sf_dir):
    return SES.bursts(SES.sessions(_points(spark, sf_dir), KEYS, GAP), BURST, RATE)


@query
def steps_by_session(spark, sf_dir):
    """In batch what ``stream_step_intervals`` gives as a stream."""
    points = SES.with_sessions(_points(spark, sf_dir), KEYS, SILENCE)
    steps = SER.step_intervals(points, (*KEYS, "session"))
    return steps.select(*KEYS, "ts", "line_no", "value", "until")


@query
def held_together(spark, sf_dir):
    """Which speeds held at the same time as which modes, by log."""
    steps = SER.step_intervals(_points(spark, sf_dir), KEYS)
    side = lambda name: steps.filter(F.col("query_signal") == f"Bus__{name}_rx_v")
    return OVE.held_together(side("Speed"), side("Mode"), ["file_path"])


def _long_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two hours a line from December on, some lines up to half a day late, some without a time."""
    events = D.table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 7 == 3, 12).otherwise(0)
    ts = F.expr("timestamp_ntz'2019-12-20 00:00:00'") + F.make_dt_interval(hours=2 * F.col("event_id") - late)
    text = F.when(F.col("event_id") % 13 == 5, F.lit("    at frame")).otherwise(
        F.concat(F.date_format(ts, "MM-dd HH:mm:ss.SSS"), F.lit("   612   634 "))
    )
    lines = events.select(
        F.col("event_id").cast("bigint").alias("line_no"),
        F.concat(F.lit("log_"), F.col("event_id") % 4).alias("file_path"), text.alias("value"),
    )
    return lines.withColumn("ts", log_timestamp(F.col("value"), YEA.LEAP_ANCHOR))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return YEA.with_years(_long_log(spark, sf_dir), 2019, key="line_no")


@query
def assign_years(spark, sf_dir):
    return _dated(spark, sf_dir).select("file_path", "line_no", "year", "ts")


@query
def window_over_new_year(spark, sf_dir):
    """A slice with continuation lines from the old year into the new one."""
    target = F.expr("timestamp_ntz'2020-01-01 00:00:00'")
    lines = _dated(spark, sf_dir)
    return WIN.window_with_continuations(lines, target, 2 * 86400, key="line_no").select("file_path", "line_no", "ts")


@query
def window_on_leap_day(spark, sf_dir):
    target = F.expr("timestamp_ntz'2020-02-29 12:00:00'")
    return WIN.filter_time_window(_dated(spark, sf_dir), target, 43200).select("file_path", "line_no", "ts")


@query
def accuracy_rollup(spark, sf_dir):
    levels = ACC.accuracy_levels(D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir))
    return ROL.accuracy_rollup(levels.withColumnRenamed("file_path", "log"))


@query
def payload_size_rollup(spark, sf_dir):
    return ROL.payload_size_rollup(D.message_table(spark, sf_dir))


@query
def indexed_name_search(spark, sf_dir):
    """The name list searched through its index; the same words as a scan finds."""
    names = DIC.format_signal_names(D.dictionary(spark, sf_dir))
    index = scratch_path(spark, "name-index")
    NAM.write_name_index(names.select("name", "place"), index, "place")
    found = None
    for word in ("_2", "speed", "000__c", "MSG_1", "x", "none such", " "):
        hits = NAM.indexed_search(spark, index, word, 100, "place").select(F.lit(word).alias("query"), "name")
        found = hits if found is None else found.union(hits)
    return found


@query
def reconcile_messages(spark, sf_dir):
    """Messages against what a scorer found, as multisets of their fields."""
    fields = ["time", "type", "service_id", "method_id", "payload"]
    found = D.found_messages(spark, sf_dir).withColumns({"type": F.lower("type"), "payload": F.lower(F.trim("payload"))})
    return REC.reconcile(D.message_table(spark, sf_dir), found, fields)


#: no, signal, msgid, start byte and bit, length, little-endian, signed, multiplexor, its value
_FIELDS_OF = (
    (0, "Selector", "0196", 0, 0, 2, True, False, True, None),
    (1, "Always", "0196", 1, 7, 8, None, True, None, None),
    (2, "Zero", "0196", 1, 4, 10, True, True, None, 0),
    (3, "One", "0196", 2, 7, 12, False, True, None, 1),
    (4, "Two", "0196", 1, 0, 16, True, None, None, 2),
    (5, "Plain", "0197", 0, 3, 18, True, True, None, None),
)


def _field_definitions(spark: SparkSession) -> DataFrame:
    names = "no int, query_signal string, msgid string, start_byte int, start_bit int, length int, " \
        "little_endian boolean, is_signed boolean, is_multiplexor boolean, mux_value int"
    rows = fixed_rows(spark, names, list(_FIELDS_OF))
    return rows.drop("no").withColumns({
        "choices": F.create_map().cast("map<string,string>"), "factor": F.lit(0.5), "offset": F.lit(-3.0),
    })


@query
def decode_multiplexed(spark, sf_dir):
    """Little-endian, signed and multiplexed signals of all messages."""
    rows = MUX.decode_fields(D.message_table(spark, sf_dir), _field_definitions(spark))
    return rows.select("line_no", "query_signal", "decoded_bits", F.col("number").cast("bigint").alias("number"), "physical_value")


@query
def daily_payload_digests(spark, sf_dir):
    """States of each day, written, merged to months and held against exact counts."""
    messages = D.message_table(spark, sf_dir).withColumns({"month": F.left("time", F.lit(2)), "day": F.left("time", F.lit(5))})
    folder = scratch_path(spark, "digests")
    DIG.digests(messages, ["month", "day"]).write.parquet(folder)
    states = spark.read.parquet(folder)
    exact = messages.groupBy("month").agg(
        F.count_distinct("payload").alias("payloads"),
        F.percentile(F.size(payload_bytes(F.col("payload"))), F.lit(0.5)).alias("_half"),
    )
    top = DIG.frequent_pairs(DIG.merged(states, ["month"]), 1).select("month", "pair", "messages_of_pair")
    error = F.abs(DIG.distinct_payloads() - F.col("payloads"))
    return DIG.merged(states, ["month"]).join(exact, "month").join(top, "month").select(
        "month", "messages", "payloads", "messages_of_pair",
        (error <= F.greatest(F.lit(1.0), DIG.DISTINCT_ERROR * F.col("payloads"))).alias("distinct_ok"),
        (F.abs(DIG.size_quantile(0.5) - F.col("_half")) <= 1).alias("half_ok"),
    )


def _one_document_a_file(spark: SparkSession, documents: DataFrame, label: str) -> str:
    """Each text of the column ``value`` as a file of its own."""
    path = scratch_path(spark, label)
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def scan_json_array_files(spark, sf_dir):
    """Files that hold one array of records each, over many lines."""
    record = F.to_json(F.struct("time", "type", "service_id", "method_id", "payload"))
    groups = D.message_table(spark, sf_dir).groupBy(F.floor(F.col("line_no") / 500)).agg(F.collect_list(record).alias("r"))
    text = F.concat(F.lit("[\n"), F.array_join("r", ",\n"), F.lit("\n]")).alias("value")
    path = _one_document_a_file(spark, groups.select(text), "record-files")
    return records.read_json_records(spark, path, schemas.PARSED_MESSAGE)


@query
def scan_dictionary_files(spark, sf_dir):
    """Whole nested dictionaries, one of a hundred parts per file, with the place of each signal in its file."""
    part = D.table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    plain = F.to_json(F.struct(
        F.lit("0001").alias("msgid"), F.lit(0).alias("start_byte"), F.lit(0).alias("start_bit"), F.lit(1).alias("length"),
    ))
    entry = F.to_json(F.struct(
        F.lpad(F.hex("p_partkey"), 4, "0").alias("msgid"), (F.col("p_size") % 8).alias("start_byte"),
        F.lit(7).alias("start_bit"), F.col("p_size").alias("length"), F.create_map(F.lit("1"), F.col("p_type")).alias("choices"),
    ))
    received = F.concat(
        F.lit('"'), F.col("p_brand"), F.lit("_"), k, F.lit('": {"F'), k, F.lit('": {"sig_a": '), entry,
        F.lit(', "sig_b": '), plain, F.lit("}}"),
    )
    sent = F.concat(F.lit('"F'), k, F.lit('": {"sig_c": '), plain, F.lit("}"))
    parts = part.select(F.floor(F.col("p_partkey") / 100).alias("file"), F.struct("p_partkey", received.alias("rx"), sent.alias("tx")).alias("e"))
    files = parts.groupBy("file").agg(F.sort_array(F.collect_list("e")).alias("e"))
    text = F.concat(
        F.lit('{"rx": {\n'), F.array_join(F.transform("e", lambda e: e["rx"]), ",\n"), F.lit('},\n"tx": {"net": {\n'),
        F.array_join(F.transform("e", lambda e: e["tx"]), ",\n"), F.lit("}}}"),
    )
    path = _one_document_a_file(spark, files.select(text.alias("value")), "dictionary-files")
    return records.read_signal_dictionary(spark, path).select(
        "direction", "namespace", "message", "signal", "msgid", "start_byte", "start_bit", "length",
        F.col("choices")["1"].alias("choice_one"),
        *[F.col(f"place.{c}").alias(f"{c}_no") for c in ("namespace", "message", "signal")],
    )


@query
def ingest_growing_log(spark, sf_dir):
    """A log folder taken in over several runs, half of its longest file at a time."""
    folder, table = scratch_path(spark, "growing"), scratch_path(spark, "ingested")
    lines = D.log_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no")
    sinks.write_text_lines(lines, folder)
    longest = ING.log_files(spark, folder).agg(F.max("length")).first()[0] or 0
    while ING.ingest(spark, folder, table, most_bytes=longest // 2 + 1):
        pass
    return ING.read_ingested(spark, table).select("time", "type", "service_id", "method_id", "payload")


# --- reference SQL -----------------------------------------------------------

_POINTS = """(
  SELECT file_path, query_signal, try_cast('1900-' || time AS TIMESTAMP) AS ts, line_no, match_value AS value
  FROM decoded_values WHERE match_value IS NOT NULL)"""


def _sessions(gap: int) -> str:
    return f"""(
  SELECT *, max(start) OVER (PARTITION BY file_path, query_signal ORDER BY ts, line_no) AS session
  FROM (SELECT *, CASE WHEN prior IS NULL OR ts - prior > INTERVAL {gap} SECOND THEN ts END AS start
    FROM (SELECT *, lag(ts) OVER (PARTITION BY file_path, query_signal ORDER BY ts, line_no) AS prior
      FROM {_POINTS})))"""


def _steps(points: str, by: str) -> str:
    return f"""
SELECT file_path, query_signal, ts, line_no, value,
  coalesce(lead(ts) OVER (PARTITION BY {by} ORDER BY ts, line_no), last_ts) AS until
FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS nth, max(ts) OVER (PARTITION BY {by}) AS last_ts
  FROM {points} WINDOW w AS (PARTITION BY {by} ORDER BY ts, line_no))
WHERE nth = 1 OR value IS DISTINCT FROM before"""


_BY_LOG = "file_path, query_signal"
_SESSIONS = f"""
SELECT file_path, query_signal, session AS ts, max(ts) AS until, count(*) AS samples
FROM {_sessions(GAP)} GROUP BY 1, 2, 3"""
_DATED = """(
  SELECT file_path, line_no, CAST(2019 + turns AS INTEGER) AS year,
    CASE WHEN month(t) <> 2 OR day(t) <> 29 OR (2019 + turns) % 4 = 0 THEN
      make_timestamp(CAST(2019 + turns AS BIGINT), month(t), day(t), hour(t), minute(t), second(t)) END AS ts
  FROM (SELECT *, sum(CASE WHEN t - before < INTERVAL '-2' DAY THEN 1 WHEN t - before > INTERVAL 365 DAY THEN -1
      ELSE 0 END) OVER (PARTITION BY file_path, t IS NULL ORDER BY line_no) AS turns
    FROM (SELECT *, lag(t) OVER (PARTITION BY file_path, t IS NULL ORDER BY line_no) AS before
      FROM (SELECT event_id AS line_no, 'log_' || (event_id % 4) AS file_path,
        CASE WHEN event_id % 13 <> 5 THEN CAST('2000-' || strftime(TIMESTAMP '2019-12-20' + to_hours(
          2 * event_id - CASE WHEN event_id % 7 = 3 THEN 12 ELSE 0 END), '%m-%d %H:%M:%S') AS TIMESTAMP) END AS t
        FROM events))))"""
_FIELDS = "time, type, service_id, method_id, payload"
_LEVEL_SETS = "GROUPING SETS ((file_path), (file_path, service_id), (service_id, method_id), (type), ())"

_SELECTS = {
    "stream_change_points": f"""
SELECT file_path, query_signal, ts, line_no, value FROM (SELECT *, lag(value) OVER w AS before,
  row_number() OVER w AS nth FROM {_POINTS} WINDOW w AS (PARTITION BY {_BY_LOG} ORDER BY ts, line_no))
WHERE nth = 1 OR value IS DISTINCT FROM before""",
    "stream_step_intervals": _steps(_sessions(SILENCE), f"{_BY_LOG}, session"),
    "steps_by_session": _steps(_sessions(SILENCE), f"{_BY_LOG}, session"),
    "stream_asof_value": f"""
SELECT CAST(replace(target_id, '-', '') AS BIGINT) AS probe_id, log || '/' || s AS query_signal, target_ts AS ts,
  (SELECT arg_max(value, (q.ts, q.line_no)) FROM {_POINTS} q
    WHERE q.file_path = log AND q.query_signal = s AND q.ts <= target_ts) AS value
FROM (SELECT target_id, target_ts, query_signal AS s, unnest(['log_0', 'log_1', 'log_2', 'log_3']) AS log
  FROM daily_targets, definitions)""",
    "stream_sessions": _SESSIONS,
    "signal_sessions": _SESSIONS,
    "signal_silences": f"""
SELECT file_path, query_signal, until AS ts, following AS until, epoch_us(following - until) / 1000000 AS seconds
FROM (SELECT *, lead(ts) OVER (PARTITION BY {_BY_LOG} ORDER BY ts) AS following FROM ({_SESSIONS}))
WHERE following IS NOT NULL""",
    "signal_bursts": f"""
SELECT * FROM ({_SESSIONS}) WHERE samples >= {BURST} AND samples - 1 >= epoch_us(until - ts) / 1000000 * {RATE}""",
    "held_together": f"""
WITH s AS ({_steps(_POINTS, _BY_LOG)})
SELECT l.file_path, greatest(l.ts, r.ts) AS ts, least(l.until, r.until) AS until,
  l.value AS left_value, r.value AS right_value
FROM s l JOIN s r ON l.file_path = r.file_path AND l.ts < r.until AND r.ts < l.until
WHERE l.query_signal = 'Bus__Speed_rx_v' AND r.query_signal = 'Bus__Mode_rx_v'
  AND greatest(l.ts, r.ts) < least(l.until, r.until)""",
    "assign_years": f"SELECT file_path, line_no, CASE WHEN t2 THEN year END AS year, ts FROM (SELECT *, line_no % 13 <> 5 AS t2 FROM {_DATED})",
    "window_over_new_year": f"""
WITH d AS {_DATED}, i AS (
  SELECT * FROM d WHERE ts BETWEEN TIMESTAMP '2019-12-30' AND TIMESTAMP '2020-01-03'),
b AS (SELECT file_path, min(line_no) AS first FROM i GROUP BY 1),
e AS (SELECT d.file_path, min(line_no) AS last FROM d JOIN b USING (file_path)
  WHERE ts > TIMESTAMP '2020-01-03' AND line_no > first GROUP BY 1)
SELECT d.file_path, line_no, ts FROM d JOIN b USING (file_path) LEFT JOIN e USING (file_path)
WHERE (ts BETWEEN TIMESTAMP '2019-12-30' AND TIMESTAMP '2020-01-03' OR ts IS NULL)
  AND line_no >= first AND (last IS NULL OR line_no < last)""",
    "window_on_leap_day": f"""
SELECT file_path, line_no, ts FROM {_DATED}
WHERE ts BETWEEN TIMESTAMP '2020-02-29' AND TIMESTAMP '2020-03-01'""",
    "accuracy_rollup": f"""
SELECT file_path AS log, service_id, method_id, type,
  CAST(GROUPING_ID(file_path, service_id, method_id, type) AS BIGINT) AS level_of, count(*) AS truth_rows,
  count(*) FILTER (level = 'exact') AS exact_rows, count(*) FILTER (level = 'payload') AS payload_rows,
  count(*) FILTER (level = 'identity') AS identity_rows, count(*) FILTER (level = 'missing') AS missing_rows,
  count(*) FILTER (level = 'exact') / count(*) * 100 AS accuracy
FROM levels GROUP BY {_LEVEL_SETS}""",
    "payload_size_rollup": """
SELECT type, service_id, method_id, CAST(GROUPING_ID(type, service_id, method_id) AS BIGINT) AS level_of,
  count(*) AS messages, CAST(sum(n) AS BIGINT) AS bytes, CAST(min(n) AS INTEGER) AS least_bytes,
  CAST(max(n) AS INTEGER) AS most_bytes
FROM (SELECT *, CASE WHEN payload = '' THEN 0 ELSE len(string_split(payload, ' ')) END AS n FROM messages)
GROUP BY ROLLUP (type, service_id, method_id)""",
    "ingest_growing_log": "SELECT time, type, service_id, method_id, payload FROM messages",
    "scan_json_array_files": "SELECT time, type, service_id, method_id, payload FROM messages",
    "scan_dictionary_files": """
WITH p AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS INTEGER) AS nth FROM part)
SELECT 'rx' AS direction, p_brand || '_' || p_partkey AS namespace, 'F' || p_partkey AS message, 'sig_a' AS signal,
  lpad(printf('%X', p_partkey), 4, '0') AS msgid, p_size % 8 AS start_byte, 7 AS start_bit, p_size AS length,
  p_type AS choice_one, nth AS namespace_no, 0 AS message_no, 0 AS signal_no FROM p
UNION ALL SELECT 'rx', p_brand || '_' || p_partkey, 'F' || p_partkey, 'sig_b', '0001', 0, 0, 1, NULL, nth, 0, 1 FROM p
UNION ALL SELECT 'tx', 'net', 'F' || p_partkey, 'sig_c', '0001', 0, 0, 1, NULL, 0, nth, 0 FROM p""",
    "decode_multiplexed": f"""
WITH d AS (SELECT * FROM (VALUES {", ".join(
    "(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in _FIELDS_OF
)}) AS t(no, query_signal, msgid, start_byte, start_bit, length, little, signed, is_mux, mux_value)),
f AS (SELECT *, upper(b[1] || b[2]) AS id, list_transform(b, lambda t: CAST('0x' || t AS INTEGER)) AS v FROM frames
  WHERE n >= 3 AND b[3] = '01'),
p AS (SELECT f.line_no, f.n, f.v, d.*, list_transform(range(0, length), lambda i: CASE WHEN coalesce(little, false)
    THEN start_byte * 8 + start_bit + i ELSE (start_byte + (7 - start_bit + i) // 8) * 8 + 7 - (7 - start_bit + i) % 8 END) AS place
  FROM f JOIN d ON d.msgid = f.id),
q AS (SELECT *, array_to_string(CASE WHEN coalesce(little, false) THEN list_reverse(bits) ELSE bits END, '') AS decoded_bits
  FROM (SELECT *, list_transform(place, lambda k: (v[4 + k // 8] >> (k % 8)) & 1) AS bits
    FROM p WHERE 3 + list_max(place) // 8 < n)),
r AS (SELECT *, list_sum(list_transform(range(0, length), lambda i: CAST(substr(decoded_bits, CAST(i AS INTEGER) + 1, 1) AS BIGINT)
    << (length - 1 - i)))::BIGINT - CASE WHEN coalesce(signed, false) AND decoded_bits[1] = '1' THEN 1::BIGINT << length ELSE 0 END AS number
  FROM q)
SELECT r.line_no, query_signal, decoded_bits, number, number * 0.5::DOUBLE - 3.0::DOUBLE AS physical_value
FROM r LEFT JOIN (SELECT line_no, number AS chosen FROM r WHERE is_mux) s ON s.line_no = r.line_no
WHERE mux_value IS NULL OR mux_value = chosen""",
    "daily_payload_digests": """
SELECT month, CAST(sum(n) AS BIGINT) AS messages, (SELECT count(DISTINCT payload) FROM messages m WHERE left(m.time, 2) = month)
  AS payloads, max(n) AS messages_of_pair, true AS distinct_ok, true AS half_ok
FROM (SELECT left(time, 2) AS month, service_id, method_id, count(*) AS n FROM messages GROUP BY ALL) GROUP BY month""",
    "indexed_name_search": """
SELECT query, name FROM (SELECT q.query, n.name,
  row_number() OVER (PARTITION BY q.query ORDER BY namespace_no, row_no, sig_no) AS nth
  FROM (VALUES ('_2'), ('speed'), ('000__c'), ('MSG_1'), ('x'), ('none such')) AS q(query)
  JOIN (SELECT *, message || '__' || signal || '_' || direction || '_v' AS name FROM dictionary) n
    ON contains(lower(n.name), lower(q.query)))
WHERE nth <= 100""",
    "reconcile_messages": f"""
WITH f AS (SELECT time, lower(type) AS type, service_id, method_id, lower(trim(payload)) AS payload FROM found_messages),
a AS (SELECT {_FIELDS}, count(*) AS n FROM messages GROUP BY ALL), b AS (SELECT {_FIELDS}, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT {_FIELDS} FROM messages EXCEPT ALL SELECT {_FIELDS} FROM f),
r AS (SELECT {_FIELDS} FROM f EXCEPT ALL SELECT {_FIELDS} FROM messages),
x AS (SELECT {_FIELDS}, 'left' AS side, count(*) AS surplus FROM l GROUP BY ALL
  UNION ALL SELECT {_FIELDS}, 'right', count(*) FROM r GROUP BY ALL)
SELECT x.*, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows
FROM x LEFT JOIN a USING ({_FIELDS}) LEFT JOIN b USING ({_FIELDS})""",
}

ORACLE_SQL = {
    name: _compose(f"SELECT * FROM ({sql})" if sql.lstrip().startswith("WITH") else sql) for name, sql in _SELECTS.items()
}
