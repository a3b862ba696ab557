"""Inputs of the operators, derived by Spark from the driver's tables.

The tables hold no bus logs.  Each binding is a lazy DataFrame over whole
tables, so the work of every query grows with them; ``oracle.py`` states the
same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from busweave.operators.computed import with_computed
from busweave.operators.messages import extract_messages
from busweave.plans.analysis import decode_messages
from busweave.functions.text import log_timestamp
from busweave.session import fixed_rows, scratch_path
from busweave.sources.sinks import write_line_table, write_message_table

TARGET = "01-15 12:00:00.000"
HALF_WINDOW = 6 * 3600
TARGET_TS = "timestamp_ntz'1900-01-15 12:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target() -> Column:
    return F.expr(TARGET_TS)


# --- log text ---------------------------------------------------------------

# Line forms that the message patterns fit.
_LOG_TEXT = """
  CASE WHEN event_id % 13 = 5 THEN concat('    at frame ', event_id)
    WHEN event_type IN ('view', 'click') THEN concat(
      head, 'D vehicle-service: SomeipCOmm :: RX Message [0/', lower(hex(event_id)),
      ']:service:', lower(hex(191 + user_id % 4)),
      ' ,Method:', lower(hex(32768 + event_id % 3)), ',payload:', payload, ' ')
    WHEN event_type IN ('signup', 'purchase') THEN concat(
      head, 'D vehicle-service: TX Message SomeipComm::send  : service:', 193 + user_id % 4,
      ',method:', 1 + event_id % 3, ', response Payload: ', upper(payload), ' ')
    ELSE concat(head, 'I link-layer: inst 0 rx count : ', event_id) END
"""
_LOG_PAYLOAD = """
  concat_ws(' ', '01', lpad(lower(hex(150 + event_id % 3)), 2, '0'),
    if(event_id % 7 = 0, '00', '01'), lpad(lower(hex(v % 256)), 2, '0'),
    lpad(lower(hex((v div 256) % 256)), 2, '0'), lpad(lower(hex(user_id % 256)), 2, '0'),
    if(event_id % 11 = 0, null, 'ff'))
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line_no, file_path, value)``: message, status and continuation lines.

    Computed once, so that operators see a plain text column as in a file.
    """
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "floor(value * 100) AS v",
        "concat(date_format(ts, 'MM-dd HH:mm:ss.SSS'), '   612   634 ') AS head",
    )
    parts = events.selectExpr("*", f"{_LOG_PAYLOAD} AS payload")
    return with_computed(
        parts,
        {
            "line_no": F.col("event_id"),
            "file_path": F.expr("concat('log_', user_id % 4)"),
            "value": F.expr(_LOG_TEXT),
        },
        keep=[],
    )


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).withColumn("ts", log_timestamp(F.col("value")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_messages(log_lines(spark, sf_dir))


_TABLES: dict = {}
_LINE_TABLE = "line_no bigint, file_path string, value string, ts timestamp_ntz"
_MESSAGE_TABLE = (
    "line_no bigint, file_path string, time string, type string, service_id bigint, "
    "method_id bigint, payload string, day string"
)


def _written(spark: SparkSession, sf_dir: str, name: str, schema: str, write) -> DataFrame:
    """A table of the shared scratch folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        path = scratch_path(spark, name)
        write(path)
        _TABLES[key] = path
    return spark.read.schema(schema).parquet(_TABLES[key])


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed log lines as a written table, in line order."""

    def write(path):
        lines = timed_lines(spark, sf_dir).repartitionByRange("line_no")
        write_line_table(lines.sortWithinPartitions("line_no"), path)

    return _written(spark, sf_dir, "lines", _LINE_TABLE, write)


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a written table: the log is parsed once per application."""

    def write(path):
        write_message_table(extract_messages(line_table(spark, sf_dir).drop("ts")), path)

    return _written(spark, sf_dir, "messages", _MESSAGE_TABLE, write).drop("day")


def messages_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which some lack both ids."""
    gap = F.col("line_no") % 50 == 7
    keep = lambda c: F.when(~gap, F.col(c))
    return message_table(spark, sf_dir).withColumns(
        {"service_id": keep("service_id"), "method_id": keep("method_id")}
    )


def daily_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line time of each log day."""
    lines = line_table(spark, sf_dir).filter(F.col("ts").isNotNull())
    day = F.date_format("ts", "MM-dd")
    return lines.groupBy(day.alias("target_id")).agg(F.min("ts").alias("target_ts"))


# --- definitions and dictionary ---------------------------------------------

_SIGNALS = (
    # no, place, namespace, signal, msgid, byte, bit, length, min, max, offset, factor
    (0, 0, "net_a", "Speed", "0196", 0, 7, 12, 0.0, 1500.0, -10.0, 0.5),
    (1, 0, "net_a", "Mode", "0197", 1, 3, 2, None, None, None, None),
    (2, 0, "net_a", "Counter", "0198", 2, 7, 20, None, None, None, 0.25),
    (3, 0, "net_a", "Valid", "01 96", 2, 0, 1, None, None, None, None),
    (4, 0, "net_a", "Broken", "0197", 0, 7, 0, None, None, None, None),
    (5, 1, "net_b", "Level", "0198", 0, 7, 8, None, None, None, None),
    (6, 1, "net_b", "Speed", "0196", 0, 7, 8, None, None, None, 9.0),
)
_SIGNAL_SCHEMA = (
    "sig_no int, namespace_no int, namespace string, signal string, msgid string, "
    "start_byte int, start_bit int, length int, minimum double, maximum double, "
    "offset double, factor double"
)


def _labels(**choices: str) -> Column:
    parts = [F.lit(x) for pair in choices.items() for x in (pair[0].lstrip("_"), pair[1])]
    return F.create_map(*parts)


def _choices(signal: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    return (
        F.when(signal == "Mode", _labels(_0="Park", _1="Drive", _2="Hold"))
        .when(signal == "Valid", _labels(_0="off", _1="on"))
        .otherwise(none)
    )


def signal_table(spark: SparkSession) -> DataFrame:
    return fixed_rows(spark, _SIGNAL_SCHEMA, list(_SIGNALS)).withColumn(
        "choices", _choices(F.col("signal"))
    )


def with_signals(rows: DataFrame) -> DataFrame:
    """Every signal of the signal table under each row."""
    names, kinds = zip(*(field.split() for field in _SIGNAL_SCHEMA.split(",")))
    literal = lambda v: "null" if v is None else repr(v)
    structs = ", ".join(
        "named_struct(" + ", ".join(
            f"'{name}', cast({literal(v)} AS {kind})" for name, kind, v in zip(names, kinds, row)
        ) + ")"
        for row in _SIGNALS
    )
    exploded = rows.selectExpr("*", f"inline(array({structs}))")
    return exploded.withColumn("choices", _choices(F.col("signal")))


def definitions(spark: SparkSession) -> DataFrame:
    """The signals of the first namespace and Level, each under a request name."""
    name = F.concat(F.lit("Bus__"), F.col("signal"), F.lit("_rx_v"))
    return signal_table(spark).filter("sig_no <> 6").withColumn("query_signal", name)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_messages(message_table(spark, sf_dir), definitions(spark))


# --- catalogue, signal lists, properties ------------------------------------

def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message kind per customer: the first ones occur in the log, others do not."""
    k = F.col("c_custkey")
    received, sent = k < 12, k < 24
    step = F.floor(k % 12 / 4)
    service = F.when(received, 191 + k % 4).when(sent, 193 + k % 4).otherwise(1000 + k)
    method = F.when(received, 32768 + step).when(sent, 1 + step).otherwise(k)
    kinds = with_computed(
        # a few scan tasks hold all keys, and every kind becomes many requests and definitions
        table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey"),
        {
            "row_no": k,
            "service_id": service,
            "method_id": method,
            "direction": F.when(received | (k % 2 == 0) & ~sent, "rx").otherwise("tx"),
        },
        keep=[],
    )
    service, method = F.col("service_id"), F.col("method_id")
    name = F.concat(F.lit("Msg_"), service.cast("string"), F.lit("_"), method.cast("string"))
    return kinds.select(
        (F.col("row_no") + 10).alias("row_no"),
        name.alias("message_name"),
        (service % 2 == 0).alias("is_can"),
        "service_id",
        "method_id",
        "direction",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named kinds, a later duplicate of each, and three special rows."""
    kinds = message_kinds(spark, sf_dir)
    later = kinds.withColumns(
        {
            "row_no": F.col("row_no") + 1_000_000_000,
            "message_name": F.upper(F.replace("message_name", F.lit("_"), F.lit(""))),
            "is_can": ~F.col("is_can"),
        }
    )
    special = fixed_rows(
        spark,
        "row_no bigint, message_name string, is_can boolean, service_id bigint, "
        "method_id bigint, direction string",
        [
            (1, "Msg_null", True, None, None, "rx"),
            (2, "Msg_unseen", True, 1, 1, "tx"),
            (3, "Msg_nowhere", True, 191, 32768, "unknown"),
        ],
    )
    return kinds.unionByName(later).unionByName(special)


def noncan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = message_kinds(spark, sf_dir).filter("not is_can and service_id <> 195")
    name = F.col("message_name")
    return kinds.select(
        "row_no",
        F.lower(name).alias("message_name"),
        F.array(F.concat(name, F.lit("_a")), F.concat(name, F.lit("_b"))).alias("signals"),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal of the signal table under every CAN message kind."""
    kinds = message_kinds(spark, sf_dir).filter("is_can")
    place = F.struct(
        F.col("namespace_no").alias("namespace"),
        F.col("row_no").alias("message"),
        F.col("sig_no").alias("signal"),
    )
    return with_signals(kinds).select(
        "direction", "namespace", F.col("message_name").alias("message"), "signal",
        place.alias("place"),
        "msgid", "start_byte", "start_bit", "length", "choices",
        "minimum", "maximum", "offset", "factor",
    )


# some requests are repeated: each counts on its own
PROPERTY_SIGNALS = (
    "Speed", "Mode", "Counter", "Valid", "Broken", "Level", "Nope", "Speed", "Mode", "Speed"
)


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every message kind: message form, signal forms, a bad name."""
    named = catalogue(spark, sf_dir).filter("row_no < 1000000000")
    name, direction = F.col("message_name"), F.col("direction")
    forms = [F.concat(F.lit("VHAL_"), F.upper(name)), F.concat(F.lit("bad "), name)]
    forms += [
        F.concat(name, F.lit(f"__{signal}_"), F.upper(direction), F.lit("_v"))
        for signal in PROPERTY_SIGNALS
    ]
    absent = F.concat(F.lit("VHAL_absent"), name)
    return named.select(F.explode(F.array(*forms, absent)).alias("query_signal"))


# --- found messages and replies ---------------------------------------------

def found_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scorer found: frames with a bad status are missing, some payloads and
    services are wrong, and messages of the first method are found twice."""
    n = F.col("line_no")
    heard = message_table(spark, sf_dir).filter(F.substring("payload", 7, 2) != "00")
    base = heard.select(
        (n * 2).alias("place"),
        "time",
        F.upper("type").alias("type"),
        F.when(n % 10 == 3, F.col("service_id") + 1)
        .otherwise(F.col("service_id"))
        .alias("service_id"),
        "method_id",
        F.when(n % 10 == 2, F.concat(F.col("payload"), F.lit(" 00")))
        .otherwise(F.concat(F.lit(" "), F.upper("payload")))
        .alias("payload"),
    )
    copies = base.filter("method_id = 1").withColumns(
        {"place": F.col("place") + 1, "payload": F.lit("aa bb")}
    )
    return base.unionByName(copies)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer's reply per message: good, fenced, cut, ignored, oddly typed."""
    n = F.col("line_no")
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    number = F.col("service_id").cast("string")
    time_key = F.when(n % 23 == 0, "Timestamp").when(n % 29 == 0, "timestamp").otherwise("time")
    body = F.concat(
        F.lit('{"'), time_key, F.lit('": '), quote("time"),
        F.lit(', "type": '), quote("type"),
        F.lit(', "serviceId": '),
        F.when(n % 19 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number),
        F.lit(', "methodId": '), F.col("method_id").cast("string"),
        F.lit(', "payload": '), quote("payload"), F.lit("}"),
    )
    text = (
        F.when(n % 17 == 0, F.lit('{"type": "ignore"}'))
        .when(n % 31 == 0, F.lit('{"error": "not_someip"}'))
        .when(n % 37 == 0, F.lit("[1, 2]"))
        .otherwise(body)
    )
    cut = F.when(n % 9 == 0, F.left(text, F.floor(F.length(text) / 2).cast("int"))).otherwise(text)
    fenced = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    return message_table(spark, sf_dir).select("line_no", fenced.alias("reply"))


# --- catalogue sheet --------------------------------------------------------

def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet of message rows and continuation rows, in part order."""
    part = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    nbsp = "\u00a0"
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return part.select(
        F.lit("Main").alias("sheet"),
        k.alias("row_no"),
        F.when(k % 8 == 1, F.concat(F.lit(f"{nbsp}CanRxFrame"), name, F.lit(nbsp)))
        .when(k % 4 == 1, name)
        .when(k % 16 == 2, F.lit(f" {nbsp}"))
        .alias("message_name"),
        F.when(k % 5 == 0, F.lit("CANNetwork"))
        .when(k % 7 == 0, F.lit("cannetwork"))
        .otherwise(F.col("p_type"))
        .alias("component"),
        F.when(k % 3 == 0, F.concat(F.lit("0x"), F.hex(k)))
        .when(k % 3 == 1, F.concat(F.lit(nbsp), text(k), F.lit(" ")))
        .otherwise(F.concat(text(k), F.lit(".0")))
        .alias("service_id"),
        F.when(k % 6 != 0, text(size)).alias("method_id"),
        F.when(k % 4 == 0, F.lit("2"))
        .when(k % 4 == 1, F.lit(f"{nbsp}0x01"))
        .when(k % 4 == 2, F.lit("0X02 "))
        .alias("message_type"),
        F.when(k % 3 == 0, F.concat(F.lit("sig"), text(size), F.lit("["), text(size % 4), F.lit("]")))
        .when(k % 3 == 1, F.concat(F.lit("sig"), text(k), F.lit("\nb"), text(size), F.lit("[2]")))
        .alias("signal_name"),
    )


# --- bus messages -----------------------------------------------------------

def bus_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    node = lambda n: F.concat(F.lit("Node_"), n.cast("string"))
    no_nodes = F.array().cast("array<string>")
    return part.select(
        k.alias("message_no"),
        # names repeat: the later message of a name takes its place
        F.concat(F.lit("Frame_"), F.floor(k / 2).cast("string")).alias("name"),
        (k * 37).alias("frame_id"),
        F.when(k % 5 == 0, no_nodes).otherwise(F.array(node(k % 3))).alias("senders"),
        F.array(node(F.lit(3)), node(4 + k % 4)).alias("receivers"),
    )


def bus_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    numbers = F.sequence(F.lit(1), F.greatest(size % 4, F.lit(1)))
    exploded = part.filter(size % 4 > 0).select(
        k.alias("message_no"), "p_size", "p_type", F.explode(numbers).alias("signal_no")
    )
    number = F.col("signal_no")
    return exploded.select(
        "message_no",
        number.cast("bigint").alias("signal_no"),
        F.concat(F.lit("sig_"), number.cast("string")).alias("signal"),
        (F.col("p_size") + 8 * number).alias("start"),
        (1 + F.col("p_size") % 8).alias("length"),
        F.when(
            number == 1,
            F.create_map(
                F.lit("10"), F.concat(F.col("p_type"), F.lit(" ")), F.lit("9"), F.lit("off")
            ),
        ).alias("choices"),
    )


def dictionary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested dictionary text per part, as a column ``value``."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    entry = F.struct(
        F.lpad(F.hex("p_partkey"), 4, "0").alias("msgid"),
        (F.col("p_size") % 8).alias("start_byte"),
        F.lit(7).alias("start_bit"),
        F.col("p_size").alias("length"),
        F.create_map(F.lit("1"), F.col("p_type")).alias("choices"),
        F.col("p_retailprice").alias("maximum"),
    )
    plain = F.struct(
        F.lit("0001").alias("msgid"), F.lit(0).alias("start_byte"),
        F.lit(0).alias("start_bit"), F.lit(1).alias("length"),
    )
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('": '))
    text = F.concat(
        F.lit('{"rx": {'), quoted(F.col("p_brand")), F.lit("{"),
        quoted(F.concat(F.lit("F"), k)), F.lit('{"sig_a": '), F.to_json(entry),
        F.lit(', "sig_b": '), F.to_json(plain), F.lit('}}}, "tx": {"net": {'),
        quoted(F.concat(F.lit("F"), k)), F.lit('{"sig_c": '), F.to_json(plain), F.lit("}}}}"),
    )
    return part.select(text.alias("value"))
