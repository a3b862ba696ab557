"""One query per operator: (spark, sf_dir) -> DataFrame of plain columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave import constants as K, schemas
from busweave.functions import cells as S, frames as B, replies as R, text as X
from busweave.operators import (
    accuracy as ACC, catalogue as CAT, decoding as DEC, dictionary as DIC, lookup as LOOK,
    matching as MAT, messages as MSG, samples as SAM, scoring as SCO, series as SER,
    windowing as WIN,
)
from busweave.plans import analysis as ANA, scoring as SCORING
from busweave.session import scratch_path, settle
from busweave.sources import bus, logs, records, sheets, sinks
from busweave.workload import bindings as D

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _joined(array, sep: str = ","):
    return F.array_join(array, sep)


def _write_lines(spark, sf_dir, label):
    """The log as text files, in line order."""
    path = scratch_path(spark, label)
    lines = D.log_lines(spark, sf_dir)
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
    sinks.write_text_lines(ordered, path)
    return path


# --- scans, sources, sinks --------------------------------------------------

@query
def scan_log_lines(spark, sf_dir):
    lines = logs.read_log_lines(spark, _write_lines(spark, sf_dir, "log"))
    return lines.select("value", "ts")


@query
def scan_nonblank_lines(spark, sf_dir):
    path = scratch_path(spark, "blank")
    lines = D.log_lines(spark, sf_dir).withColumn(
        "value",
        F.when(F.col("line_no") % 13 == 5, "  \t").otherwise(
            F.concat(F.lit(" \t"), F.col("value"), F.lit(" "))
        ),
    )
    sinks.write_text_lines(lines, path)
    return logs.read_nonblank_lines(spark, path).select("value")


@query
def scan_json_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    record = F.struct("time", "type", "service_id", "method_id", "payload")
    arrays = D.messages(spark, sf_dir).select(
        F.concat(F.lit("["), F.to_json(record), F.lit("]")).alias("value")
    )
    sinks.write_text_lines(arrays, path)
    return records.read_json_lines(spark, path, schemas.PARSED_MESSAGE)


@query
def scan_signal_dictionary(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    sinks.write_text_lines(D.dictionary_documents(spark, sf_dir), path)
    flat = records.flatten_signal_dictionary(spark.read.text(path), F.col("value"))
    return flat.select(
        "direction", "namespace", "message", "signal", "msgid", "start_byte",
        "start_bit", "length", F.col("choices")["1"].alias("choice_one"), "maximum", "factor",
    )


@query
def scan_catalogue_rows(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    rows = D.sheet_rows(spark, sf_dir)
    at = {position: name for name, position in sheets.POSITIONS.items()}
    cells = [
        (F.col(at[i]) if i in at else F.lit(f"x{i}")).alias(f"column {i}")
        for i in range(K.SHEET_SIGNAL_NAME + 1)
    ]
    rows.select(*cells, F.col("row_no").alias("row")).write.csv(
        path, header=True, quoteAll=True, escape='"', nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return sheets.read_catalogue_rows(spark, path, K.SHEET_SIGNAL_NAME + 1)


@query
def scan_bus_messages(spark, sf_dir):
    messages, signals = (scratch_path(spark, n) for n in ("bus-messages", "bus-signals"))
    D.bus_messages(spark, sf_dir).write.parquet(messages)
    D.bus_signals(spark, sf_dir).write.parquet(signals)
    return bus.read_bus_messages(spark, messages, signals).select(
        "message_no", "name", "frame_id",
        _joined("senders").alias("senders"), _joined("receivers").alias("receivers"),
        "signal_no", "signal", "start", "length", F.col("choices")["9"].alias("choice_nine"),
    )


@query
def scan_signal_names(spark, sf_dir):
    path = scratch_path(spark, "names")
    names = DIC.format_signal_names(D.dictionary(spark, sf_dir))
    padded = names.select(
        F.explode(
            F.array(F.concat(F.lit("  "), F.col("name"), F.lit(" ")), F.lit("   "))
        ).alias("value")
    )
    sinks.write_text_lines(padded, path)
    return logs.read_signal_names(spark, path).select("name")


def _samples(spark, sf_dir):
    labelled = SAM.label_log_lines(D.line_table(spark, sf_dir).drop("ts"))
    return SAM.split_train_val(labelled, "line_no")


def _written_split(spark, sf_dir):
    path = scratch_path(spark, "samples")
    sinks.write_jsonl_split(_samples(spark, sf_dir), path)
    return records.read_training_sets(
        spark, f"{path}/split=train", f"{path}/split=validation"
    )


@query
def scan_training_jsonl(spark, sf_dir):
    return records.count_samples(_written_split(spark, sf_dir))


@query
def write_json_records(spark, sf_dir):
    path = scratch_path(spark, "json")
    found = D.messages(spark, sf_dir)
    sinks.write_json_records(found, path)
    return records.read_json_lines(spark, path, found.schema)


@query
def write_jsonl_split(spark, sf_dir):
    return _written_split(spark, sf_dir)


@query
def write_text_lines(spark, sf_dir):
    return spark.read.text(_write_lines(spark, sf_dir, "text"))


@query
def write_time_ordered(spark, sf_dir):
    path = scratch_path(spark, "ordered")
    found = D.messages(spark, sf_dir)
    sinks.write_time_ordered(found, path, ties=("line_no",))
    return records.read_json_lines(spark, path, found.schema)


# --- projections, filters, predicates ---------------------------------------

@query
def filter_message_lines(spark, sf_dir):
    return MSG.filter_message_lines(D.log_lines(spark, sf_dir))


@query
def extract_log_timestamp(spark, sf_dir):
    return D.timed_lines(spark, sf_dir).select("line_no", "ts")


@query
def message_window(spark, sf_dir):
    """Messages around a time, read from the table of parsed messages."""
    path = scratch_path(spark, "message-table")
    sinks.write_message_table(D.message_table(spark, sf_dir), path)
    return records.read_message_table(spark, path, D.target(), D.HALF_WINDOW).select(
        "line_no", "time", "type", "service_id", "method_id", "payload"
    )


@query
def filter_time_window(spark, sf_dir):
    lines = D.line_table(spark, sf_dir)
    windows = WIN.filter_time_windows(lines, D.daily_targets(spark, sf_dir), 3600)
    return windows.select("target_id", "line_no", "ts", "value")


@query
def window_with_continuations(spark, sf_dir):
    lines = D.line_table(spark, sf_dir)
    return WIN.window_with_continuations(
        lines, D.target(), D.HALF_WINDOW, key="line_no"
    ).select("file_path", "line_no", "ts", "value")


@query
def extract_rx_messages(spark, sf_dir):
    return MSG.extract_rx_messages(D.log_lines(spark, sf_dir))


@query
def extract_tx_messages(spark, sf_dir):
    return MSG.extract_tx_messages(D.log_lines(spark, sf_dir))


@query
def extract_messages(spark, sf_dir):
    return D.messages(spark, sf_dir)


@query
def normalize_payload(spark, sf_dir):
    raw = F.regexp_replace("value", "(?i)^.*payload:", "")
    return D.log_lines(spark, sf_dir).select(
        "line_no", X.normalize_payload(raw).alias("payload")
    )


@query
def parse_property_name(spark, sf_dir):
    return MAT.parse_properties(D.properties(spark, sf_dir))


@query
def clean_message_name(spark, sf_dir):
    return D.sheet_rows(spark, sf_dir).select(
        "row_no", S.clean_message_name(F.col("message_name")).alias("message_name")
    )


@query
def normalise_msg_type(spark, sf_dir):
    return D.sheet_rows(spark, sf_dir).select(
        "row_no", S.normalise_msg_type(F.col("message_type")).alias("message_type")
    )


@query
def parse_direction(spark, sf_dir):
    return D.sheet_rows(spark, sf_dir).select(
        "row_no", S.message_direction(F.col("message_type")).alias("direction")
    )


@query
def to_decimal_id(spark, sf_dir):
    price = D.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_no"),
        S.decimal_id_of_number(F.col("p_retailprice")).alias("number_id"),
    )
    cells = D.sheet_rows(spark, sf_dir).select(
        "row_no", S.decimal_id(F.col("service_id")).alias("text_id")
    )
    return cells.join(price, "row_no")


@query
def build_catalogue(spark, sf_dir):
    return CAT.build_catalogue(D.sheet_rows(spark, sf_dir))


@query
def exclude_can_messages(spark, sf_dir):
    kept = CAT.exclude_can_messages(CAT.fill_message_rows(D.sheet_rows(spark, sf_dir)))
    return kept.select("row_no", "group_no", "group_name")


@query
def search_signal_names(spark, sf_dir):
    names = DIC.format_signal_names(D.dictionary(spark, sf_dir))
    return DIC.search_signal_names(names, " SPEED ", K.SEARCH_LIMIT, "place").select("name")


@query
def format_signal_name(spark, sf_dir):
    return DIC.format_signal_names(D.dictionary(spark, sf_dir)).select(
        "direction", "namespace", "message", "signal", "name"
    )


@query
def split_signal_name(spark, sf_dir):
    name = F.col("query_signal")
    return D.properties(spark, sf_dir).select(
        "query_signal", X.signal_owner(name).alias("ecu"), X.signal_label(name).alias("name")
    )


@query
def build_prompt(spark, sf_dir):
    return MSG.filter_message_lines(D.log_lines(spark, sf_dir)).select(
        "line_no", R.build_prompt(F.col("value"), "Parse the line.").alias("prompt")
    )


@query
def token_budget(spark, sf_dir):
    documents = D.table(spark, sf_dir, "documents")
    return documents.select("doc_id", R.token_budget(F.length("text")).alias("budget"))


@query
def clean_response(spark, sf_dir):
    return D.replies(spark, sf_dir).select(
        "line_no", R.clean_response(F.col("reply")).alias("reply")
    )


def _read_replies(spark, sf_dir):
    return SCO.read_replies(D.replies(spark, sf_dir)).drop("reply")


@query
def parse_response_json(spark, sf_dir):
    return _read_replies(spark, sf_dir).select(
        "line_no", "type", "service_id", "method_id", "payload"
    )


@query
def classify_response(spark, sf_dir):
    return _read_replies(spark, sf_dir).select("line_no", "outcome")


@query
def coalesce_time_key(spark, sf_dir):
    return _read_replies(spark, sf_dir).select("line_no", "time")


@query
def format_training_sample(spark, sf_dir):
    return SAM.label_log_lines(D.log_lines(spark, sf_dir), "Parse the line.").select(
        "line_no", "text"
    )


@query
def label_log_lines(spark, sf_dir):
    return SAM.label_log_lines(D.log_lines(spark, sf_dir)).select(
        "line_no", "kind", "answer"
    )


# --- joins ------------------------------------------------------------------

def _looked_up(spark, sf_dir):
    return MAT.lookup_catalogue_message(
        MAT.parse_properties(D.properties(spark, sf_dir)), D.catalogue(spark, sf_dir)
    )


@query
def lookup_catalogue_message(spark, sf_dir):
    return _looked_up(spark, sf_dir).select(
        "query_signal", "found", "message_name", "is_can", "service_id", "method_id",
        "direction",
    )


@query
def match_messages(spark, sf_dir):
    matched = MAT.match_messages(
        _looked_up(spark, sf_dir), D.messages_with_gaps(spark, sf_dir)
    )
    return matched.select("query_signal", "message_name", "matched", "line_no", "payload")


@query
def lookup_noncan_signals(spark, sf_dir):
    found = MAT.lookup_noncan_signals(
        _looked_up(spark, sf_dir), D.noncan_records(spark, sf_dir)
    )
    return found.select("query_signal", "list_message", _joined("signals").alias("signals"))


@query
def lookup_signal_definition(spark, sf_dir):
    asked = MAT.parse_properties(D.properties(spark, sf_dir)).filter("kind = 'signal'")
    found = DIC.lookup_signal_definition(asked, D.dictionary(spark, sf_dir))
    return found.select(
        "query_signal", "namespace", "def_message", "def_signal", "msgid", "start_byte",
        "start_bit", "length", "minimum", "maximum", "offset", "factor",
    )


def _definitions(spark, sf_dir):
    return MAT.route_definitions(
        _looked_up(spark, sf_dir), D.noncan_records(spark, sf_dir), D.dictionary(spark, sf_dir)
    )


@query
def route_definition_lookup(spark, sf_dir):
    return _definitions(spark, sf_dir).select(
        "query_signal", "source", "error", "note", "result_message",
        _joined("signals").alias("signals"), "namespace", "def_signal", "msgid", "length",
    )


def _decode_columns(decoded):
    return decoded.select(
        "query_signal", "line_no", "note", "decoded_bits",
        F.col("signal_value").cast("bigint").alias("signal_value"),
        "physical_value", "match_value", "match_label", "match_status", "payload", "time",
    )


@query
def decode_join(spark, sf_dir):
    """Settled requests and definitions, then one join of the messages."""
    looked_up = settle(_looked_up(spark, sf_dir), "requests")
    definitions = MAT.route_definitions(
        looked_up, D.noncan_records(spark, sf_dir), D.dictionary(spark, sf_dir)
    )
    return _decode_columns(DEC.decode_requests(
        looked_up, D.messages_with_gaps(spark, sf_dir), settle(definitions, "definitions")
    ))


@query
def accuracy_exact(spark, sf_dir):
    return ACC.accuracy_exact(
        D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir)
    ).select("line_no", "found_payload", "level")


@query
def accuracy_identity_mismatch(spark, sf_dir):
    return ACC.accuracy_identity_mismatch(
        D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir)
    ).select("line_no", "time", "type", "service_id", "method_id")


@query
def accuracy_missing(spark, sf_dir):
    return ACC.accuracy_missing(
        D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir)
    ).select("line_no", "time", "type", "service_id", "method_id")


@query
def accuracy_mismatch_detail(spark, sf_dir):
    return ACC.accuracy_mismatch_detail(
        D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir)
    )


@query
def asof_signal_value(spark, sf_dir):
    """The value of every signal at the start of every log day's first line."""
    points = SER.all_points(D.decoded(spark, sf_dir))
    signal = F.concat(F.lit("Bus__"), F.col("signal"), F.lit("_rx_v"))
    probes = D.with_signals(D.daily_targets(spark, sf_dir)).filter("sig_no <> 6").select(
        F.replace("target_id", F.lit("-"), F.lit("")).cast("bigint").alias("probe_id"),
        signal.alias("query_signal"),
        F.col("target_ts").alias("ts"),
    )
    return SER.asof_signal_value(points, probes)


@query
def known_pair_flag(spark, sf_dir):
    return SAM.known_pair_flag(D.message_table(spark, sf_dir)).select(
        "line_no", "type", "service_id", "method_id", "known"
    )


# --- aggregations -----------------------------------------------------------

@query
def accuracy_report_by_log(spark, sf_dir):
    """Two logs of equal lines, of which one was scored."""
    log = lambda name: F.lit(name).alias("log")
    truth, found = D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir)
    both = truth.select("*", log("a")).union(truth.select("*", log("b")))
    return ACC.accuracy_report(both, found.select("*", log("a")), scope=("log",))


@query
def change_points_by_log(spark, sf_dir):
    """Change points of two logs with equal times, each for itself."""
    decoded = D.decoded(spark, sf_dir).withColumn("log", F.pmod("line_no", F.lit(2)))
    points = SER.all_points(decoded, scope=("log",))
    return SER.change_points(points, ("log", "query_signal")).select(
        "log", "query_signal", "line_no", "value"
    )


@query
def accuracy_report(spark, sf_dir):
    return ACC.accuracy_report(D.message_table(spark, sf_dir), D.found_messages(spark, sf_dir))


@query
def reply_counts(spark, sf_dir):
    return SCO.reply_counts(D.line_table(spark, sf_dir).drop("ts"), _read_replies(spark, sf_dir))


@query
def catalogue_counts(spark, sf_dir):
    return CAT.catalogue_counts(D.sheet_rows(spark, sf_dir))


def _damaged_samples(spark, sf_dir):
    """Samples of which some answers are cut off."""
    cut = F.left(F.col("text"), F.length("text") - 5)
    return _samples(spark, sf_dir).withColumn(
        "text", F.when(F.col("line_no") % 41 == 0, cut).otherwise(F.col("text"))
    )


@query
def sample_type_counts(spark, sf_dir):
    return SAM.sample_type_counts(_damaged_samples(spark, sf_dir))


@query
def payload_size_histogram(spark, sf_dir):
    """Payloads are repeated up to 49-fold so that every size class occurs."""
    n = F.col("line_no")
    longer = F.regexp_replace(
        "value", r"(?i)(payload: ?)([0-9a-f ]+)$", "$1"
    )
    bytes_ = F.regexp_extract("value", r"(?i)payload: ?([0-9a-f ]+)$", 1)
    lines = D.line_table(spark, sf_dir).drop("ts").withColumn(
        "value",
        F.when(
            bytes_ != "", F.concat(longer, F.repeat(bytes_, (1 + n % 49).cast("int")))
        ).otherwise(F.col("value")),
    )
    return SAM.payload_size_histogram(SAM.label_log_lines(lines))


@query
def hex_conversion_audit(spark, sf_dir):
    wrong = F.regexp_replace("text", r'"serviceId": 191', '"serviceId": 190')
    samples = _samples(spark, sf_dir).withColumn(
        "text", F.when(F.col("line_no") % 6 == 0, wrong).otherwise(F.col("text"))
    )
    return SAM.hex_conversion_audit(samples)


@query
def signals_per_message(spark, sf_dir):
    return CAT.message_signals(D.sheet_rows(spark, sf_dir)).select(
        "group_no", "message_name", "row_no", "cell_pos", "signal"
    )


@query
def build_signal_dictionary(spark, sf_dir):
    flat = DIC.build_signal_dictionary(
        D.bus_messages(spark, sf_dir), D.bus_signals(spark, sf_dir)
    )
    return flat.select(
        "direction", "namespace", "message", "signal", "msgid", "start_byte", "start_bit",
        "length", F.col("choices")["10"].alias("choice_ten"),
    )


@query
def dictionary_round_trip(spark, sf_dir):
    """A built dictionary written, read back and looked up by its own names."""
    flat = DIC.build_signal_dictionary(D.bus_messages(spark, sf_dir), D.bus_signals(spark, sf_dir))
    path = scratch_path(spark, "dictionary")
    flat.write.parquet(path)
    read = spark.read.parquet(path)
    asked = DIC.format_signal_names(read).select(
        "name", "message", "signal", F.col("direction").alias("asked_direction")
    )
    return DIC.lookup_signal_definition(asked, read).select(
        "name", "namespace", "def_message", "msgid", "start_byte", "start_bit", "length"
    )


@query
def group_by_signal(spark, sf_dir):
    rows = SER.rows_by_signal(D.decoded(spark, sf_dir))
    return rows.groupBy("query_signal").agg(
        F.count("*").alias("decoded_rows"), F.count("match_value").alias("values"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
    )


@query
def line_length_stats(spark, sf_dir):
    return SCO.line_length_stats(MSG.filter_message_lines(D.line_table(spark, sf_dir).drop("ts")))


@query
def signal_count(spark, sf_dir):
    return DIC.signal_count(DIC.format_signal_names(D.dictionary(spark, sf_dir)))


@query
def distinct_nodes(spark, sf_dir):
    return DIC.distinct_nodes(D.bus_messages(spark, sf_dir))


# --- window-style operators -------------------------------------------------

@query
def change_points(spark, sf_dir):
    return SER.change_points(SER.all_points(D.decoded(spark, sf_dir)))


@query
def step_intervals(spark, sf_dir):
    return SER.step_intervals(SER.all_points(D.decoded(spark, sf_dir)))


@query
def signal_points(spark, sf_dir):
    points = SER.signal_points(D.decoded(spark, sf_dir), D.target(), D.HALF_WINDOW)
    return points.orderBy("query_signal", "ts", "line_no")


@query
def fill_message_rows(spark, sf_dir):
    return CAT.fill_message_rows(D.sheet_rows(spark, sf_dir)).select(
        "row_no", "group_no", "group_name", "group_is_can"
    )


@query
def batch_by_length(spark, sf_dir):
    lines = MSG.filter_message_lines(D.line_table(spark, sf_dir).drop("ts"))
    return SCO.batch_by_length(lines).select("line_no", "length", "batch", "budget")


@query
def first_match_per_key(spark, sf_dir):
    found = D.message_table(spark, sf_dir)
    return LOOK.first_match_per_key(found, ["service_id", "method_id"], "line_no")


@query
def last_match_per_key(spark, sf_dir):
    found = D.found_messages(spark, sf_dir)
    return LOOK.last_match_per_key(found, list(ACC.IDENTITY), "place")


# --- sorts, limits, sampling ------------------------------------------------

@query
def sort_by_length(spark, sf_dir):
    return SCO.sort_by_length(MSG.filter_message_lines(D.line_table(spark, sf_dir).drop("ts")))


@query
def sort_by_time_text(spark, sf_dir):
    parsed = _read_replies(spark, sf_dir).filter("outcome = 'parsed'")
    return SCO.sort_by_time_text(parsed)


@query
def sorted_choice_keys(spark, sf_dir):
    keys = B.sorted_choice_keys(F.col("choices"))
    return D.bus_signals(spark, sf_dir).filter("choices is not null").select(
        "message_no", "signal_no", _joined(keys.cast("array<string>")).alias("keys")
    )


@query
def shuffle_samples(spark, sf_dir):
    rows = D.line_table(spark, sf_dir).drop("ts").select("line_no")
    return SAM.shuffle_samples(rows, "line_no")


@query
def split_train_val(spark, sf_dir):
    rows = D.line_table(spark, sf_dir).drop("ts").select("line_no")
    return SAM.split_train_val(rows, "line_no")


@query
def quota_sample(spark, sf_dir):
    lines = MSG.with_message(D.line_table(spark, sf_dir).drop("ts"), "m").select("line_no", "m.*")
    flagged = SAM.known_pair_flag(lines)
    kind = F.coalesce("type", F.lit(K.NOT_A_MESSAGE))
    size = F.size(B.payload_bytes(F.coalesce("payload", F.lit(""))))
    rows = flagged.withColumn("stratum", SAM.stratum(kind, size, F.col("known")))
    return SAM.quota_sample(rows.select("line_no", "stratum"), "line_no")


@query
def example_per_type(spark, sf_dir):
    return SAM.example_per_type(
        SAM.label_log_lines(D.line_table(spark, sf_dir).drop("ts"), "Parse the line."), "line_no"
    )


# --- set operations ---------------------------------------------------------

@query
def union_property_results(spark, sf_dir):
    """Results of all properties in one table, per property."""
    matched = MAT.match_messages(_looked_up(spark, sf_dir), D.message_table(spark, sf_dir))
    return matched.groupBy("query_signal").agg(
        F.count("*").alias("rows"), F.count_if("matched").alias("matches")
    )


@query
def union_directions(spark, sf_dir):
    return DIC.union_directions(D.bus_messages(spark, sf_dir))


# --- scalar functions -------------------------------------------------------

def _frames(spark, sf_dir):
    return D.message_table(spark, sf_dir).withColumn("frm", B.frame(F.col("payload")))


@query
def payload_bytes(spark, sf_dir):
    tokens = B.payload_bytes(F.col("payload"))
    return D.message_table(spark, sf_dir).select(
        "line_no", F.size(tokens).alias("bytes"), _joined(tokens).alias("tokens")
    )


@query
def frame_message_id(spark, sf_dir):
    return _frames(spark, sf_dir).select("line_no", F.col("frm.id").alias("frame_id"))


@query
def frame_status_filter(spark, sf_dir):
    return _frames(spark, sf_dir).filter(B.status_ok(F.col("frm"))).select(
        "line_no", "payload"
    )


@query
def extract_bits(spark, sf_dir):
    return D.decoded(spark, sf_dir).select(
        "line_no", "query_signal", "decoded_bits",
        F.col("signal_value").cast("bigint").alias("signal_value"),
    )


@query
def decode_skip_reason(spark, sf_dir):
    """Each message against one definition in turn, so that every check fails somewhere."""
    turn = (F.floor(F.col("line_no") / 3) % 6).cast("int").alias("sig_no")
    pairs = _frames(spark, sf_dir).select("line_no", "frm", turn).join(
        D.definitions(spark), "sig_no"
    )
    field = B.BitField.of(F.col("start_byte"), F.col("start_bit"), F.col("length"))
    return pairs.select(
        "line_no", "sig_no", B.skip_reason(F.col("frm"), F.col("msgid"), field).alias("status")
    )


@query
def choice_label(spark, sf_dir):
    return D.decoded(spark, sf_dir).filter(B.has_choices(F.col("choices"))).select(
        "line_no", "query_signal", "match_label", "match_status"
    )


@query
def scale_physical(spark, sf_dir):
    return D.decoded(spark, sf_dir).select("line_no", "query_signal", "physical_value")


@query
def range_check(spark, sf_dir):
    return D.decoded(spark, sf_dir).filter(~B.has_choices(F.col("choices"))).select(
        "line_no", "query_signal", "match_status"
    )


@query
def expand_signal_array(spark, sf_dir):
    return D.sheet_rows(spark, sf_dir).select(
        "row_no",
        F.posexplode(S.expand_signal_cell(F.col("signal_name"))).alias("position", "signal"),
    )


@query
def bit_position(spark, sf_dir):
    signals = bus.join_bus_messages(D.bus_messages(spark, sf_dir), D.bus_signals(spark, sf_dir))
    start = F.col("start")
    return signals.select(
        "message_no", "signal_no",
        B.frame_id_text(F.col("frame_id")).alias("msgid"),
        B.start_byte_of(start).alias("start_byte"),
        B.start_bit_of(start).alias("start_bit"),
        B.choice_map(F.col("choices"))["10"].alias("choice_ten"),
    )


@query
def choice_index(spark, sf_dir):
    keys = B.sorted_choice_keys(F.col("choices"))
    rows = D.decoded(spark, sf_dir).filter(B.has_choices(F.col("choices")))
    return rows.select(
        "line_no", "query_signal",
        B.choice_index(keys, F.col("signal_value")).alias("place"),
    )


@query
def normalise_unit(spark, sf_dir):
    rows = D.decoded(spark, sf_dir).filter("match_value is not null")
    scales = SER.signal_scales(D.decoded(spark, sf_dir)).select(
        "query_signal",
        F.coalesce("minimum", F.lit(0.0)).alias("low"),
        F.coalesce("maximum", F.lit(1.0)).alias("high"),
    )
    unit = B.unit_position(F.col("match_value"), F.col("low"), F.col("high"))
    return rows.select("line_no", "query_signal", "match_value").join(
        scales, "query_signal"
    ).select("line_no", "query_signal", unit.alias("unit"))


# --- user operators, whole analyses -----------------------------------------

def _pattern_scorer():
    """Factory of a deterministic test scorer, which takes a line apart at its marks.

    The factory is nested, so that it reaches the workers by value.
    """

    def make():
        import json

        def answer(prompt):
            line = next((text for text in prompt.splitlines() if " Message " in text), "")
            head, mark, payload = line.lower().rpartition("payload:")
            if not mark:
                return '{"type": "ignore"}'
            service, _, rest = head.rpartition("service:")[2].partition(",method:")
            received = " rx message" in head
            base = 16 if received else 10
            return json.dumps({
                "time": " ".join(line.split()[:2]), "type": "rx" if received else "tx",
                "serviceId": int(service.strip(), base), "methodId": int(rest.split(",")[0], base),
                "payload": payload.strip(),
            })

        return lambda prompts, budget: [answer(p) for p in prompts]

    return make


@query
def score_in_batches(spark, sf_dir):
    lines = D.line_table(spark, sf_dir).drop("ts")
    scored = SCO.score_in_batches(lines, _pattern_scorer(), "Parse the line.")
    return SCO.read_replies(scored).select(
        "line_no", "failed", "outcome", "time", "type", "service_id", "method_id", "payload"
    )


@query
def score_log(spark, sf_dir):
    """A scoring run: only message lines are sent."""
    lines = D.line_table(spark, sf_dir).drop("ts")
    run = SCORING.score_log(lines, _pattern_scorer(), "Parse the line.")
    return run.replies.select(
        "line_no", "failed", "outcome", "time", "type", "service_id", "method_id", "payload"
    )


@query
def score_log_counts(spark, sf_dir):
    lines = D.line_table(spark, sf_dir).drop("ts")
    return SCORING.score_log(lines, _pattern_scorer(), "Parse the line.").counts


@query
def analyze_properties(spark, sf_dir):
    lines = D.line_table(spark, sf_dir)
    result = ANA.analyze_log(
        lines, D.target(), D.HALF_WINDOW, "file_path", "line_no",
        D.properties(spark, sf_dir), D.catalogue(spark, sf_dir),
        D.noncan_records(spark, sf_dir), D.dictionary(spark, sf_dir),
    )
    return _decode_columns(result.decoded)


@query
def stream_decoded_log(spark, sf_dir):
    """The log folder followed to its end as a stream, decoded and appended."""
    from busweave.streaming import follow

    folder = _write_lines(spark, sf_dir, "followed")
    out, checkpoint = scratch_path(spark, "followed-out"), scratch_path(spark, "followed-state")
    rows = follow.follow_decoded(follow.follow_log_lines(spark, folder), D.definitions(spark))
    kept = rows.select("time", "query_signal", "decoded_bits", "match_value")
    follow.append_json(kept, out, checkpoint, available_now=True).awaitTermination()
    return records.read_json_lines(spark, out, kept.schema)
