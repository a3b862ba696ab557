"""Reference SQL per query, for an engine that reads the same tables.

Every text is one WITH chain over the driver's tables; ``_CTES`` holds the
shared derivations, stated independently of the Spark code.
"""

from __future__ import annotations

import re

# --- fixed values: patterns of message lines ---
_TS = r"(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)"
_RX = (
    _TS + r".*?SomeipCOmm :: RX Message.*?service:([0-9a-fA-F]+)\s*"
    r",Method:([0-9a-fA-F]+),payload:(.*)"
)
_TX = (
    _TS + r".*?TX Message SomeipComm::send.*?service:(\d+),method:(\d+)"
    r",\s*response Payload:\s*(.*)"
)
_NBSP = "chr(160)"

_CTES = {
    "log_lines": """
  SELECT event_id AS line_no, 'log_' || (user_id % 4) AS file_path,
    CASE WHEN event_id % 13 = 5 THEN '    at frame ' || event_id
      WHEN event_type IN ('view', 'click') THEN head
        || 'D vehicle-service: SomeipCOmm :: RX Message [0/' || printf('%x', event_id)
        || ']:service:' || printf('%x', 191 + user_id % 4)
        || ' ,Method:' || printf('%x', 32768 + event_id % 3)
        || ',payload:' || payload || ' '
      WHEN event_type IN ('signup', 'purchase') THEN head
        || 'D vehicle-service: TX Message SomeipComm::send  : service:' || (193 + user_id % 4)
        || ',method:' || (1 + event_id % 3)
        || ', response Payload: ' || upper(payload) || ' '
      ELSE head || 'I link-layer: inst 0 rx count : ' || event_id END AS value
  FROM (SELECT *, strftime(ts, '%m-%d %H:%M:%S.%g') || '   612   634 ' AS head,
      '01 ' || printf('%02x', 150 + event_id % 3) || ' '
      || CASE WHEN event_id % 7 = 0 THEN '00' ELSE '01' END || ' '
      || printf('%02x', v % 256) || ' ' || printf('%02x', (v // 256) % 256) || ' '
      || printf('%02x', user_id % 256)
      || CASE WHEN event_id % 11 = 0 THEN '' ELSE ' ff' END AS payload
    FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS v FROM events))""",
    "timed_lines": r"""
  SELECT *, try_cast('1900-' || nullif(regexp_extract(value,
      '^\s*(\d\d-\d\d \d\d:\d\d:\d\d\.\d{1,6})', 1), '') AS TIMESTAMP) AS ts
  FROM log_lines""",
    "messages": f"""
  SELECT line_no, file_path,
    CASE WHEN rx THEN regexp_extract(value, '{_RX}', 1, 'i')
      ELSE regexp_extract(value, '{_TX}', 1, 'i') END AS time,
    CASE WHEN rx THEN 'rx' ELSE 'tx' END AS type,
    CASE WHEN rx THEN CAST('0x' || regexp_extract(value, '{_RX}', 2, 'i') AS BIGINT)
      ELSE CAST(regexp_extract(value, '{_TX}', 2, 'i') AS BIGINT) END AS service_id,
    CASE WHEN rx THEN CAST('0x' || regexp_extract(value, '{_RX}', 3, 'i') AS BIGINT)
      ELSE CAST(regexp_extract(value, '{_TX}', 3, 'i') AS BIGINT) END AS method_id,
    trim(regexp_replace(lower(CASE WHEN rx THEN regexp_extract(value, '{_RX}', 4, 'i')
      ELSE regexp_extract(value, '{_TX}', 4, 'i') END), '\\s+', ' ', 'g')) AS payload
  FROM (SELECT *, regexp_matches(value, '{_RX}', 'i') AS rx,
      regexp_matches(value, '{_TX}', 'i') AS tx FROM log_lines) WHERE rx OR tx""",
    "messages_with_gaps": """
  SELECT * REPLACE (CASE WHEN line_no % 50 <> 7 THEN service_id END AS service_id,
    CASE WHEN line_no % 50 <> 7 THEN method_id END AS method_id) FROM messages""",
    "daily_targets": """
  SELECT strftime(ts, '%m-%d') AS target_id, min(ts) AS target_ts
  FROM timed_lines WHERE ts IS NOT NULL GROUP BY ALL""",
    "signal_table": """
  SELECT * FROM (VALUES
    (0, 0, 'net_a', 'Speed', '0196', 0, 7, 12, 0.0::DOUBLE, 1500.0::DOUBLE, -10.0::DOUBLE,
      0.5::DOUBLE, MAP {}::MAP(VARCHAR, VARCHAR)),
    (1, 0, 'net_a', 'Mode', '0197', 1, 3, 2, NULL, NULL, NULL, NULL,
      MAP {'0': 'Park', '1': 'Drive', '2': 'Hold'}),
    (2, 0, 'net_a', 'Counter', '0198', 2, 7, 20, NULL, NULL, NULL, 0.25, MAP {}),
    (3, 0, 'net_a', 'Valid', '01 96', 2, 0, 1, NULL, NULL, NULL, NULL,
      MAP {'0': 'off', '1': 'on'}),
    (4, 0, 'net_a', 'Broken', '0197', 0, 7, 0, NULL, NULL, NULL, NULL, MAP {}),
    (5, 1, 'net_b', 'Level', '0198', 0, 7, 8, NULL, NULL, NULL, NULL, MAP {}),
    (6, 1, 'net_b', 'Speed', '0196', 0, 7, 8, NULL, NULL, NULL, 9.0, MAP {}))
    AS t(sig_no, namespace_no, namespace, signal, msgid, start_byte, start_bit, length,
      minimum, maximum, "offset", factor, choices)""",
    "definitions": """
  SELECT *, 'Bus__' || signal || '_rx_v' AS query_signal FROM signal_table WHERE sig_no <> 6""",
    "frames": """
  SELECT *, string_split(payload, ' ') AS b, len(string_split(payload, ' ')) AS n,
    array_to_string(list_transform(string_split(payload, ' '),
      lambda t: lpad(bin(CAST('0x' || t AS INTEGER)), 8, '0')), '') AS bits
  FROM messages""",
    "decoded": """
  SELECT *, CASE WHEN cardinality(choices) = 0 THEN
      signal_value * coalesce(factor, 1.0) + coalesce("offset", 0.0) END AS physical_value,
    CASE WHEN cardinality(choices) > 0 THEN choices[CAST(signal_value AS VARCHAR)] END AS match_label
  FROM (SELECT *, list_sum(list_transform(range(1, length + 1),
        lambda i: CAST(substr(decoded_bits, i, 1) AS BIGINT) << (length - i)))::BIGINT
        AS signal_value
    FROM (SELECT m.*, d.*, substr(bits, (3 + start_byte) * 8 + 8 - start_bit, length)
          AS decoded_bits
      FROM frames m JOIN definitions d
        ON upper(b[1] || b[2]) = replace(upper(msgid), ' ', '')
      WHERE n >= 3 AND b[3] = '01' AND length >= 1 AND 3 + start_byte < n
        AND (3 + start_byte) * 8 + 7 - start_bit + length <= n * 8))""",
    "decoded_values": """
  SELECT *, CASE WHEN cardinality(choices) > 0 AND match_label IS NOT NULL THEN 'matched'
      WHEN cardinality(choices) > 0 THEN 'no_match'
      WHEN physical_value BETWEEN coalesce(minimum, 0.0) AND coalesce(maximum, 0.0)
        THEN 'valid' ELSE 'out_of_range' END AS match_status,
    CASE WHEN match_label IS NOT NULL THEN signal_value::DOUBLE ELSE physical_value END
      AS match_value FROM decoded""",
    "points": """
  SELECT query_signal, try_cast('1900-' || time AS TIMESTAMP) AS ts, line_no,
    match_value AS value FROM decoded_values WHERE match_value IS NOT NULL""",
    "message_kinds": """
  SELECT k + 10 AS row_no, 'Msg_' || service_id || '_' || method_id AS message_name,
    service_id % 2 = 0 AS is_can, service_id, method_id, direction
  FROM (SELECT c_custkey AS k,
    CASE WHEN c_custkey < 12 THEN 191 + c_custkey % 4 WHEN c_custkey < 24
      THEN 193 + c_custkey % 4 ELSE 1000 + c_custkey END AS service_id,
    CASE WHEN c_custkey < 12 THEN 32768 + (c_custkey % 12) // 4 WHEN c_custkey < 24
      THEN 1 + (c_custkey % 12) // 4 ELSE c_custkey END AS method_id,
    CASE WHEN c_custkey < 12 OR (c_custkey >= 24 AND c_custkey % 2 = 0) THEN 'rx'
      ELSE 'tx' END AS direction FROM customer)""",
    "catalogue": """
  SELECT * FROM message_kinds UNION ALL
  SELECT row_no + 1000000000, upper(replace(message_name, '_', '')), NOT is_can,
    service_id, method_id, direction FROM message_kinds UNION ALL
  SELECT * FROM (VALUES (1, 'Msg_null', true, NULL, NULL, 'rx'),
    (2, 'Msg_unseen', true, 1, 1, 'tx'), (3, 'Msg_nowhere', true, 191, 32768, 'unknown'))""",
    "noncan_records": """
  SELECT row_no, lower(message_name) AS message_name,
    message_name || '_a,' || message_name || '_b' AS signals
  FROM message_kinds WHERE NOT is_can AND service_id <> 195""",
    "dictionary": """
  SELECT namespace_no, row_no, sig_no, k.direction, s.namespace, k.message_name AS message, s.signal, s.msgid,
    s.start_byte, s.start_bit, s.length, s.choices, s.minimum, s.maximum, s."offset",
    s.factor, row_number() OVER (PARTITION BY k.direction, lower(k.message_name),
      lower(s.signal) ORDER BY namespace_no, row_no, sig_no) AS nth
  FROM message_kinds k, signal_table s WHERE k.is_can""",
    "properties": """
  SELECT unnest(['VHAL_' || upper(message_name), 'bad ' || message_name,
    'VHAL_absent' || message_name] || list_transform(
      ['Speed', 'Mode', 'Counter', 'Valid', 'Broken', 'Level', 'Nope', 'Speed', 'Mode', 'Speed'],
      lambda s: message_name || '__' || s || '_' || upper(direction) || '_v'))
    AS query_signal
  FROM catalogue WHERE row_no < 1000000000""",
    "requests": r"""
  SELECT query_signal,
    CASE WHEN m THEN 'message' WHEN s THEN 'signal' END AS kind,
    CASE WHEN m THEN substr(query_signal, 6)
      WHEN s THEN regexp_extract(query_signal, '^(.+?)__(.+?)_(rx|tx)_v$', 1, 'i') END
      AS message,
    CASE WHEN NOT m AND s THEN
      regexp_extract(query_signal, '^(.+?)__(.+?)_(rx|tx)_v$', 2, 'i') END AS signal,
    CASE WHEN NOT m AND s THEN
      lower(regexp_extract(query_signal, '^(.+?)__(.+?)_(rx|tx)_v$', 3, 'i')) END
      AS asked_direction,
    CASE WHEN NOT m AND NOT s THEN 'unrecognised property name' END AS error
  FROM (SELECT query_signal, lower(query_signal) LIKE 'vhal\_%' ESCAPE '\' AS m,
    regexp_matches(query_signal, '^(.+?)__(.+?)_(rx|tx)_v$', 'i') AS s FROM properties)""",
    "looked_up": """
  SELECT r.query_signal, r.kind, r.message, r.signal, r.asked_direction,
    c.message_name IS NOT NULL AS found, c.message_name, c.is_can, c.service_id,
    c.method_id, c.direction
  FROM requests r LEFT JOIN (SELECT *, row_number() OVER (
      PARTITION BY replace(lower(message_name), '_', '') ORDER BY row_no) AS nth
    FROM catalogue) c ON nth = 1
    AND replace(lower(c.message_name), '_', '') = replace(lower(r.message), '_', '')
  WHERE r.kind IS NOT NULL""",
    "matched": """
  SELECT l.*, g.line_no IS NOT NULL AS matched, g.line_no, g.time, g.payload
  FROM looked_up l LEFT JOIN messages_with_gaps g
    ON g.service_id IS NOT DISTINCT FROM l.service_id
    AND g.method_id IS NOT DISTINCT FROM l.method_id AND g.type = lower(l.direction)
  WHERE l.found""",
    "routed": """
  SELECT l.query_signal,
    CASE WHEN found AND NOT is_can AND n.message_name IS NOT NULL THEN 'signals'
      WHEN found AND is_can AND kind = 'signal' AND d.message IS NOT NULL
        THEN 'definition' END AS source,
    CASE WHEN NOT found THEN '''' || l.message || ''' not found in the message catalogue'
      WHEN NOT is_can AND n.message_name IS NULL THEN 'not found'
      WHEN is_can AND kind = 'signal' AND d.message IS NULL THEN 'not found' END AS error,
    CASE WHEN found AND is_can AND kind = 'message' THEN
      'isCAN is true; signal-level lookup requires a signal-typed propertyname.' END AS note,
    CASE WHEN found AND NOT is_can THEN n.message_name
      WHEN found AND is_can AND kind = 'signal' THEN d.message END AS result_message,
    CASE WHEN found AND NOT is_can THEN n.signals END AS signals,
    found AND is_can AND kind = 'signal' AS by_definition, d.*
  FROM looked_up l
  LEFT JOIN noncan_records n ON n.message_name = lower(l.message)
  LEFT JOIN dictionary d ON d.nth = 1 AND d.direction = l.asked_direction
    AND lower(d.message) = lower(l.message) AND lower(d.signal) = lower(l.signal)""",
    "found_base": """
  SELECT line_no * 2 AS place, time, upper(type) AS type,
    CASE WHEN line_no % 10 = 3 THEN service_id + 1 ELSE service_id END AS service_id,
    method_id, CASE WHEN line_no % 10 = 2 THEN payload || ' 00'
      ELSE ' ' || upper(payload) END AS payload
  FROM messages WHERE substr(payload, 7, 2) <> '00'""",
    "found_messages": """
  SELECT * FROM found_base UNION ALL
  SELECT place + 1, time, type, service_id, method_id, 'aa bb' FROM found_base
  WHERE method_id = 1""",
    "found_clean": r"""
  SELECT place, time, lower(type) AS type, service_id, method_id,
    trim(regexp_replace(lower(payload), '\s+', ' ', 'g')) AS payload FROM found_messages""",
    "levels": """
  SELECT m.*, f.payload AS found_payload,
    CASE WHEN f.payload = m.payload THEN 'exact' WHEN f.payload IS NOT NULL THEN 'payload'
      WHEN m.time IN (SELECT time FROM found_messages) THEN 'identity'
      ELSE 'missing' END AS level
  FROM messages m LEFT JOIN (SELECT *, row_number() OVER (
      PARTITION BY time, type, service_id, method_id ORDER BY place DESC) AS nth
    FROM found_clean) f ON nth = 1 AND f.time = m.time AND f.type = m.type
    AND f.service_id = m.service_id AND f.method_id = m.method_id""",
    "replies": r"""
  SELECT line_no, CASE WHEN line_no % 4 = 0 THEN '```json' || chr(10) || cut || chr(10) || '```'
    ELSE cut END AS reply
  FROM (SELECT line_no, CASE WHEN line_no % 9 = 0 THEN left(text, length(text) // 2)
      ELSE text END AS cut
    FROM (SELECT line_no, CASE WHEN line_no % 17 = 0 THEN '{"type": "ignore"}'
        WHEN line_no % 31 = 0 THEN '{"error": "not_someip"}'
        WHEN line_no % 37 = 0 THEN '[1, 2]'
        ELSE '{"' || CASE WHEN line_no % 23 = 0 THEN 'Timestamp'
            WHEN line_no % 29 = 0 THEN 'timestamp' ELSE 'time' END
          || '": "' || time || '", "type": "' || type || '", "serviceId": '
          || CASE WHEN line_no % 19 = 0 THEN '"' || service_id || '"'
            ELSE CAST(service_id AS VARCHAR) END
          || ', "methodId": ' || method_id || ', "payload": "' || payload || '"}' END AS text
      FROM messages))""",
    "clean_replies": r"""
  SELECT line_no, trim(regexp_replace(regexp_replace(reply,
    '^(```json)?(```)?', ''), '```$', ''), ' ' || chr(10)) AS reply FROM replies""",
    "read_replies": """
  SELECT line_no,
    CASE WHEN NOT object OR kind IS NULL THEN 'error' WHEN kind = 'ignore' THEN 'ignored'
      WHEN kind IN ('rx', 'tx') THEN 'parsed' ELSE 'error' END AS outcome,
    CASE WHEN object THEN coalesce(json_extract_string(reply, '$.time'),
      json_extract_string(reply, '$.timestamp'), json_extract_string(reply, '$.Time'),
      json_extract_string(reply, '$.Timestamp'), '') END AS time,
    kind AS type,
    CASE WHEN object AND json_type(reply, '$.serviceId') = 'UBIGINT'
      THEN CAST(json_extract(reply, '$.serviceId') AS BIGINT) END AS service_id,
    CASE WHEN object AND json_type(reply, '$.methodId') = 'UBIGINT'
      THEN CAST(json_extract(reply, '$.methodId') AS BIGINT) END AS method_id,
    CASE WHEN object THEN json_extract_string(reply, '$.payload') END AS payload
  FROM (SELECT *, CASE WHEN object THEN json_extract_string(reply, '$.type') END AS kind
    FROM (SELECT line_no, reply, CASE WHEN json_valid(reply)
      THEN json_type(reply) = 'OBJECT' ELSE false END AS object FROM clean_replies))""",
    "sheet_rows": f"""
  SELECT 'Main' AS sheet, p_partkey AS row_no,
    CASE WHEN p_partkey % 8 = 1 THEN {_NBSP} || 'CanRxFrame' || replace(p_name, ' ', '_') || {_NBSP}
      WHEN p_partkey % 4 = 1 THEN replace(p_name, ' ', '_')
      WHEN p_partkey % 16 = 2 THEN ' ' || {_NBSP} END AS message_name,
    CASE WHEN p_partkey % 5 = 0 THEN 'CANNetwork' WHEN p_partkey % 7 = 0 THEN 'cannetwork'
      ELSE p_type END AS component,
    CASE WHEN p_partkey % 3 = 0 THEN '0x' || printf('%X', p_partkey)
      WHEN p_partkey % 3 = 1 THEN {_NBSP} || p_partkey || ' ' ELSE p_partkey || '.0' END
      AS service_id,
    CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS VARCHAR) END AS method_id,
    CASE WHEN p_partkey % 4 = 0 THEN '2' WHEN p_partkey % 4 = 1 THEN {_NBSP} || '0x01'
      WHEN p_partkey % 4 = 2 THEN '0X02 ' END AS message_type,
    CASE WHEN p_partkey % 3 = 0 THEN 'sig' || p_size || '[' || (p_size % 4) || ']'
      WHEN p_partkey % 3 = 1 THEN 'sig' || p_partkey || chr(10) || 'b' || p_size || '[2]' END
      AS signal_name
  FROM part""",
    "sheet_clean": f"""
  SELECT *, regexp_replace(trim(replace(message_name, {_NBSP}, '')), '^canrxframe', '', 'i')
      AS name,
    trim(replace(component, {_NBSP}, '')) = 'CANNetwork' AS can,
    CASE WHEN message_type IS NULL THEN ''
      WHEN p = '2' THEN '0x2' ELSE p END AS kind,
    CASE WHEN service_id LIKE '0x%' THEN CAST(lower(service_id) AS BIGINT)
      ELSE try_cast(CASE WHEN service_id NOT LIKE '%.%'
        THEN trim(replace(service_id, {_NBSP}, '')) END AS BIGINT) END AS text_id
  FROM (SELECT *, lower(trim(replace(message_type, {_NBSP}, ''))) AS p FROM sheet_rows)""",
    "sheet_filled": """
  SELECT f.*, g.name AS group_name, g.can AS group_is_can
  FROM (SELECT *, last_value(CASE WHEN message_name IS NOT NULL THEN row_no END IGNORE NULLS)
      OVER (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_no
    FROM sheet_clean) f LEFT JOIN sheet_clean g ON g.row_no = f.group_no""",
    "sheet_signals": r"""
  SELECT row_no, list_transform(flatten(list_transform(
    list_filter(string_split(signal_name, chr(10)), lambda s: trim(s) <> ''),
    lambda s: CASE WHEN regexp_matches(s, '\[\d+\]$') THEN
      list_transform(range(0, CAST(regexp_extract(s, '\[(\d+)\]$', 1) AS BIGINT)),
        lambda i: regexp_extract(s, '^(.+?)\[', 1) || '[' || i || ']') ELSE [s] END)),
    lambda s: s) AS signals FROM sheet_rows""",
    "bus_messages": """
  SELECT p_partkey AS message_no, 'Frame_' || (p_partkey // 2) AS name,
    p_partkey * 37 AS frame_id,
    CASE WHEN p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE ['Node_' || (p_partkey % 3)] END
      AS senders,
    ['Node_3', 'Node_' || (4 + p_partkey % 4)] AS receivers
  FROM part""",
    "bus_signals": """
  SELECT message_no, signal_no, 'sig_' || signal_no AS signal,
    CAST(p_size + 8 * signal_no AS INTEGER) AS start, 1 + p_size % 8 AS length,
    CASE WHEN signal_no = 1 THEN p_type || ' ' END AS ten,
    CASE WHEN signal_no = 1 THEN 'off' END AS nine
  FROM (SELECT p_partkey AS message_no, p_size, p_type,
    unnest(range(1, p_size % 4 + 1)) AS signal_no FROM part)""",
    "directions": """
  SELECT 'tx' AS direction, unnest(senders) AS node, message_no, name, frame_id
  FROM bus_messages UNION ALL
  SELECT 'rx', unnest(receivers), message_no, name, frame_id FROM bus_messages""",
    "labelled": r"""
  SELECT l.line_no, l.value, coalesce(m.type, 'not_someip') AS kind, m.service_id,
    m.method_id, m.payload,
    CASE WHEN m.type IS NULL THEN '{' || chr(10) || '  "error": "not_someip"' || chr(10) || '}'
      ELSE '{' || chr(10) || '  "time": "' || m.time || '",' || chr(10)
        || '  "type": "' || m.type || '",' || chr(10)
        || '  "serviceId": ' || m.service_id || ',' || chr(10)
        || '  "methodId": ' || m.method_id || ',' || chr(10)
        || '  "payload": "' || m.payload || '"' || chr(10) || '}' END AS answer
  FROM log_lines l LEFT JOIN messages m USING (line_no)""",
    "flat_dictionary": """
  SELECT *, row_number() OVER (PARTITION BY direction, lower(name), lower(signal)
    ORDER BY first_no, node <> 'Node_3', message_no, signal_no) AS nth
  FROM (SELECT d.direction, d.node, d.name, d.frame_id, d.message_no, d.first_no, s.signal_no,
      s.signal, s.start, s.length
    FROM (SELECT *, min(message_no) OVER (PARTITION BY direction, node) AS first_no
      FROM (SELECT *, row_number() OVER (PARTITION BY direction, node, name
        ORDER BY message_no DESC) AS last_no FROM directions) WHERE last_no = 1) d
    JOIN bus_signals s ON s.message_no = d.message_no)""",
    "split_rows": """
  SELECT *, CASE WHEN CAST('0x' || left(md5('42:' || line_no), 15) AS BIGINT) < 1037629354146162304
    THEN 'train' ELSE 'validation' END AS split FROM labelled""",
}

_PROMPT = (
    "'### Instruction:' || chr(10) || '{0}' || chr(10) || chr(10) || '### Input:' || chr(10) "
    "|| value || chr(10) || chr(10) || '### Response:' || chr(10)"
)


def _known_pairs() -> str:
    from busweave import constants as K

    rows = [f"('rx', {s}, {m})" for s, m in K.KNOWN_RX_PAIRS]
    rows += [f"('tx', {s}, {m})" for s, m in K.KNOWN_TX_PAIRS]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(type, service_id, method_id)"


_CTES["known_pairs"] = "\n  " + _known_pairs()


def _closure(sql: str) -> list[str]:
    """Shared derivations a text uses, in definition order."""
    names = list(_CTES)
    mentions = lambda text: {n for n in names if re.search(rf"\b{n}\b", text)}
    wanted, todo = set(), mentions(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= mentions(_CTES[name]) - {name}
    return [n for n in names if n in wanted]


def _compose(sql: str) -> str:
    used = _closure(sql)
    if not used:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in used) + "\n" + sql


_DECODE_COLUMNS = """query_signal, line_no, note, decoded_bits, signal_value,
  physical_value, CASE WHEN match_status = 'matched' THEN signal_value::DOUBLE
    ELSE physical_value END AS match_value, match_label, match_status, payload, time"""


def _analysis(matched: str) -> str:
    """Decoded values and notes of the property requests over a message relation."""
    return f"""
, pairs AS (
  SELECT m.query_signal, m.line_no, m.time, m.payload, r.choices, r.minimum, r.maximum,
    r."offset", r.factor, r.length, r.start_byte, r.start_bit,
    string_split(m.payload, ' ') AS b, len(string_split(m.payload, ' ')) AS n,
    array_to_string(list_transform(string_split(m.payload, ' '),
      lambda t: lpad(bin(CAST('0x' || t AS INTEGER)), 8, '0')), '') AS bits
  FROM {matched} m JOIN (SELECT DISTINCT ON (query_signal) * FROM routed) r
    ON r.query_signal = m.query_signal
  WHERE m.is_can AND m.matched AND r.by_definition AND r.msgid IS NOT NULL
    AND replace(upper(r.msgid), ' ', '') = upper(replace(left(m.payload, 5), ' ', ''))),
sliced AS (
  SELECT *, substr(bits, (3 + start_byte) * 8 + 8 - start_bit, length) AS decoded_bits
  FROM pairs WHERE b[3] = '01' AND length >= 1 AND 3 + start_byte < n
    AND (3 + start_byte) * 8 + 7 - start_bit + length <= n * 8),
valued AS (
  SELECT *, list_sum(list_transform(range(1, length + 1),
    lambda i: CAST(substr(decoded_bits, i, 1) AS BIGINT) << (length - i)))::BIGINT
    AS signal_value FROM sliced),
scaled AS (
  SELECT *, CASE WHEN cardinality(choices) = 0 THEN signal_value * coalesce(factor, 1.0)
      + coalesce("offset", 0.0) END AS physical_value,
    CASE WHEN cardinality(choices) > 0 THEN choices[CAST(signal_value AS VARCHAR)] END AS match_label
  FROM valued),
judged AS (
  SELECT *, CAST(NULL AS VARCHAR) AS note,
    CASE WHEN cardinality(choices) > 0 AND match_label IS NOT NULL THEN 'matched'
      WHEN cardinality(choices) > 0 THEN 'no_match'
      WHEN physical_value BETWEEN coalesce(minimum, 0.0) AND coalesce(maximum, 0.0)
        THEN 'valid' ELSE 'out_of_range' END AS match_status FROM scaled)
SELECT {_DECODE_COLUMNS} FROM judged
UNION ALL
SELECT query_signal, line_no, 'test_result is None, skipping', NULL, NULL, NULL, NULL, NULL,
  NULL, payload, time FROM {matched} WHERE is_can AND NOT matched"""


_MESSAGE_COLUMNS = "line_no, file_path, time, type, service_id, method_id, payload"
_WINDOW = "TIMESTAMP '1900-01-15 12:00:00'"
_SLICE = f"""
, starts AS (SELECT file_path, min(line_no) AS start_no FROM timed_lines
  WHERE ts BETWEEN {_WINDOW} - INTERVAL 6 HOUR AND {_WINDOW} + INTERVAL 6 HOUR GROUP BY 1),
stops AS (SELECT t.file_path, min(line_no) AS stop_no FROM timed_lines t
  JOIN starts s ON s.file_path = t.file_path
  WHERE ts > {_WINDOW} + INTERVAL 6 HOUR AND line_no > start_no GROUP BY 1),
slice AS (SELECT l.* FROM timed_lines l JOIN starts s ON s.file_path = l.file_path
  LEFT JOIN stops p ON p.file_path = l.file_path
  WHERE line_no >= start_no AND (stop_no IS NULL OR line_no < stop_no)
    AND (ts IS NULL OR ts BETWEEN {_WINDOW} - INTERVAL 6 HOUR AND {_WINDOW} + INTERVAL 6 HOUR))"""


def _with(head_uses: str, rest: str) -> str:
    """Compose shared derivations of a text, then continue its WITH chain."""
    used = _closure(head_uses + rest)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in used) + rest


def _selects() -> dict[str, str]:
    size = "len(list_filter(string_split(payload, ' '), lambda t: t <> ''))"
    return {
        "scan_log_lines": "SELECT value, ts FROM timed_lines",
        "scan_nonblank_lines": "SELECT value FROM (SELECT line_no, trim(value) AS value "
            "FROM log_lines) WHERE line_no % 13 <> 5",
        "scan_json_records":
            "SELECT time, type, service_id, method_id, payload FROM messages",
        "scan_signal_dictionary": """
SELECT 'rx' AS direction, p_brand AS namespace, 'F' || p_partkey AS message,
  'sig_a' AS signal, lpad(printf('%X', p_partkey), 4, '0') AS msgid,
  p_size % 8 AS start_byte, 7 AS start_bit, p_size AS length, p_type AS choice_one,
  p_retailprice AS maximum, CAST(NULL AS DOUBLE) AS factor FROM part UNION ALL
SELECT 'rx', p_brand, 'F' || p_partkey, 'sig_b', '0001', 0, 0, 1, NULL, NULL, NULL
  FROM part UNION ALL
SELECT 'tx', 'net', 'F' || p_partkey, 'sig_c', '0001', 0, 0, 1, NULL, NULL, NULL FROM part""",
        "scan_catalogue_rows": "SELECT * FROM sheet_rows",
        "scan_bus_messages": """
SELECT m.message_no, name, frame_id, array_to_string(senders, ',') AS senders,
  array_to_string(receivers, ',') AS receivers, signal_no, signal, start, length,
  nine AS choice_nine FROM bus_messages m LEFT JOIN bus_signals s ON s.message_no = m.message_no""",
        "scan_signal_names": """
SELECT message || '__' || signal || '_' || direction || '_v' AS name FROM dictionary""",
        "scan_training_jsonl":
            "SELECT split, count(*) AS samples FROM split_rows GROUP BY split",
        "write_json_records": f"SELECT {_MESSAGE_COLUMNS} FROM messages",
        "write_jsonl_split": f"SELECT split, {_PROMPT.format('@@')} || answer AS text FROM split_rows",
        "write_text_lines": "SELECT value FROM log_lines",
        "write_time_ordered": f"SELECT {_MESSAGE_COLUMNS} FROM messages",
        "filter_message_lines": """
SELECT * FROM log_lines WHERE contains(value, 'SomeipCOmm :: RX Message')
  OR contains(value, 'TX Message SomeipComm::send')""",
        "extract_log_timestamp": "SELECT line_no, ts FROM timed_lines",
        "filter_time_window": """
SELECT target_id, line_no, ts, value FROM timed_lines JOIN daily_targets
  ON ts BETWEEN target_ts - INTERVAL 1 HOUR AND target_ts + INTERVAL 1 HOUR""",
        "message_window": """
SELECT line_no, time, type, service_id, method_id, payload FROM messages
WHERE try_cast('1900-' || time AS TIMESTAMP) BETWEEN TIMESTAMP '1900-01-15 12:00:00' - INTERVAL 6 HOUR
  AND TIMESTAMP '1900-01-15 12:00:00' + INTERVAL 6 HOUR""",
        "extract_rx_messages": f"SELECT {_MESSAGE_COLUMNS} FROM messages WHERE type = 'rx'",
        "extract_tx_messages": f"SELECT {_MESSAGE_COLUMNS} FROM messages WHERE type = 'tx'",
        "extract_messages": f"SELECT {_MESSAGE_COLUMNS} FROM messages",
        "normalize_payload": r"""
SELECT line_no, trim(regexp_replace(lower(regexp_replace(value, '^.*payload:', '', 'i')),
  '\s+', ' ', 'g')) AS payload FROM log_lines""",
        "parse_property_name": "SELECT * FROM requests",
        "clean_message_name": "SELECT row_no, name AS message_name FROM sheet_clean",
        "normalise_msg_type": "SELECT row_no, kind AS message_type FROM sheet_clean",
        "parse_direction": """
SELECT row_no, CASE kind WHEN '0x01' THEN 'tx' WHEN '0x02' THEN 'rx' ELSE 'unknown' END
  AS direction FROM sheet_clean""",
        "to_decimal_id": """
SELECT row_no, text_id, CAST(trunc(p_retailprice) AS BIGINT) AS number_id
FROM sheet_clean JOIN part ON p_partkey = row_no""",
        "build_catalogue": """
SELECT sheet, row_no, name AS message_name, can AS is_can, text_id AS service_id,
  CAST(method_id AS BIGINT) AS method_id, CASE kind WHEN '0x01' THEN 'tx'
    WHEN '0x02' THEN 'rx' ELSE 'unknown' END AS direction
FROM sheet_clean WHERE name <> ''""",
        "exclude_can_messages": """
SELECT row_no, group_no, group_name FROM sheet_filled
WHERE group_name <> '' AND NOT group_is_can""",
        "search_signal_names": """
SELECT message || '__' || signal || '_' || direction || '_v' AS name FROM dictionary
WHERE contains(lower(name), 'speed') ORDER BY namespace_no, row_no, sig_no LIMIT 100""",
        "format_signal_name": """
SELECT direction, namespace, message, signal,
  message || '__' || signal || '_' || direction || '_v' AS name FROM dictionary""",
        "split_signal_name": """
SELECT query_signal, CASE WHEN contains(query_signal, '__')
    THEN split_part(query_signal, '__', 1) ELSE '' END AS ecu,
  CASE WHEN contains(query_signal, '__')
    THEN substr(query_signal, instr(query_signal, '__') + 2) ELSE query_signal END AS name
FROM properties""",
        "build_prompt": f"""
SELECT line_no, {_PROMPT.format('Parse the line.')} AS prompt FROM log_lines
WHERE contains(value, 'SomeipCOmm :: RX Message') OR contains(value, 'TX Message SomeipComm::send')""",
        "token_budget": """
SELECT doc_id, CAST(greatest(150, least(length(text) - 95, 700)) AS INTEGER) AS budget
FROM documents""",
        "clean_response": "SELECT line_no, reply FROM clean_replies",
        "parse_response_json":
            "SELECT line_no, type, service_id, method_id, payload FROM read_replies",
        "classify_response": "SELECT line_no, outcome FROM read_replies",
        "coalesce_time_key": "SELECT line_no, time FROM read_replies",
        "format_training_sample":
            f"SELECT line_no, {_PROMPT.format('Parse the line.')} || answer AS text FROM labelled",
        "label_log_lines": "SELECT line_no, kind, answer FROM labelled",
        "lookup_catalogue_message": """
SELECT query_signal, found, message_name, is_can, service_id, method_id, direction
FROM looked_up""",
        "match_messages":
            "SELECT query_signal, message_name, matched, line_no, payload FROM matched",
        "lookup_noncan_signals": """
SELECT query_signal, n.message_name AS list_message, n.signals
FROM looked_up l LEFT JOIN noncan_records n ON n.message_name = lower(l.message)""",
        "lookup_signal_definition": """
SELECT query_signal, d.namespace, d.message AS def_message, d.signal AS def_signal, d.msgid,
  d.start_byte, d.start_bit, d.length, d.minimum, d.maximum, d."offset", d.factor
FROM requests r LEFT JOIN dictionary d ON d.nth = 1 AND d.direction = r.asked_direction
  AND lower(d.message) = lower(r.message) AND lower(d.signal) = lower(r.signal)
WHERE r.kind = 'signal'""",
        "route_definition_lookup": """
SELECT query_signal, source, error, note, result_message, signals,
  CASE WHEN by_definition THEN namespace END AS namespace,
  CASE WHEN by_definition THEN signal END AS def_signal,
  CASE WHEN by_definition THEN msgid END AS msgid,
  CASE WHEN by_definition THEN length END AS length FROM routed""",
        "accuracy_exact": """
SELECT line_no, found_payload, CASE WHEN level IN ('exact', 'payload') THEN level END AS level
FROM levels""",
        "accuracy_identity_mismatch": """
SELECT line_no, time, type, service_id, method_id FROM levels WHERE level = 'identity'""",
        "accuracy_missing": """
SELECT line_no, time, type, service_id, method_id FROM levels WHERE level = 'missing'""",
        "accuracy_mismatch_detail": """
SELECT w.*, f.type AS found_type, f.service_id AS found_service_id,
  f.method_id AS found_method_id, f.payload AS found_payload, f.found_rows,
  w.type = f.type AS type_ok, w.service_id = f.service_id AS service_id_ok,
  w.method_id = f.method_id AS method_id_ok, w.payload = f.payload AS payload_ok
FROM (SELECT time, type, service_id, method_id, payload, count(*) AS truth_rows
  FROM levels WHERE level = 'identity' GROUP BY ALL) w
JOIN (SELECT time, type, service_id, method_id, payload, count(*) AS found_rows
  FROM found_clean GROUP BY ALL) f ON f.time = w.time""",
        "asof_signal_value": """
SELECT CAST(replace(target_id, '-', '') AS BIGINT) AS probe_id, p.query_signal,
  target_ts AS ts, p.value
FROM (SELECT target_id, target_ts, query_signal, (SELECT arg_max(value, (q.ts, q.line_no))
    FROM points q WHERE q.query_signal = d.query_signal AND q.ts <= target_ts) AS value
  FROM daily_targets, definitions d) p""",
        "known_pair_flag": """
SELECT line_no, m.type, m.service_id, m.method_id, k.type IS NOT NULL AS known
FROM messages m LEFT JOIN known_pairs k ON k.type = m.type
  AND k.service_id = m.service_id AND k.method_id = m.method_id""",
        "accuracy_report": """
SELECT count(*) AS truth_rows, count(*) FILTER (level = 'exact') AS exact_rows,
  count(*) FILTER (level = 'payload') AS payload_rows,
  count(*) FILTER (level = 'identity') AS identity_rows,
  count(*) FILTER (level = 'missing') AS missing_rows,
  count(*) FILTER (level = 'exact') / count(*) * 100 AS accuracy FROM levels""",
        "accuracy_report_by_log": """
SELECT 2 * count(*) AS truth_rows, count(*) FILTER (level = 'exact') AS exact_rows,
  count(*) FILTER (level = 'payload') AS payload_rows,
  count(*) FILTER (level = 'identity') AS identity_rows,
  count(*) + count(*) FILTER (level = 'missing') AS missing_rows,
  count(*) FILTER (level = 'exact') / (2 * count(*)) * 100 AS accuracy FROM levels""",
        "change_points_by_log": """
SELECT line_no % 2 AS log, query_signal, line_no, value FROM (SELECT *,
  lag(value) OVER w AS before, row_number() OVER w AS nth FROM points
  WINDOW w AS (PARTITION BY line_no % 2, query_signal ORDER BY ts, line_no))
WHERE nth = 1 OR value IS DISTINCT FROM before""",
        "reply_counts": """
SELECT (SELECT count(*) FROM log_lines) AS read_lines,
  (SELECT count(*) FROM log_lines WHERE value LIKE '%Message%') AS kept_lines,
  (SELECT count(*) FROM log_lines WHERE value NOT LIKE '%Message%') AS skipped_lines,
  count(*) FILTER (outcome = 'parsed') AS parsed,
  count(*) FILTER (outcome = 'ignored') AS ignored,
  count(*) FILTER (outcome = 'error') AS errors FROM read_replies""",
        "catalogue_counts": """
SELECT count(*) FILTER (coalesce(name, '') <> '') AS parsed,
  count(*) FILTER (coalesce(name, '') = '') AS skipped,
  count(*) FILTER (coalesce(name, '') <> '' AND can) AS skipped_can FROM sheet_clean""",
        "sample_type_counts": """
SELECT t.sample_type, count(line_no) AS samples
FROM (VALUES ('rx'), ('tx'), ('not_someip'), ('parse_error')) AS t(sample_type)
LEFT JOIN (SELECT line_no, CASE WHEN line_no % 41 = 0 THEN 'parse_error' ELSE kind END AS kind
  FROM labelled) l ON l.kind = t.sample_type GROUP BY 1""",
        "payload_size_histogram": f"""
SELECT c.size_class, count(line_no) AS samples,
  100.0::DOUBLE * count(line_no) / greatest((SELECT count(*) FROM messages), 1) AS percent
FROM (VALUES ('1-10', 0, 10), ('11-20', 11, 20), ('21-50', 21, 50), ('51-100', 51, 100),
  ('101-150', 101, 150), ('151-200', 151, 200), ('201-240', 201, 1000000))
  AS c(size_class, low, high)
LEFT JOIN (SELECT line_no, {size} * (1 + line_no % 49) AS bytes FROM messages) m
  ON bytes BETWEEN low AND high GROUP BY 1""",
        "hex_conversion_audit": """
SELECT count(*) FILTER (NOT (line_no % 6 = 0 AND service_id = 191)) AS correct,
  count(*) FILTER (line_no % 6 = 0 AND service_id = 191) AS wrong
FROM messages WHERE type = 'rx'""",
        "signals_per_message": """
SELECT group_no, group_name AS message_name, f.row_no, pos AS cell_pos, signal
FROM sheet_filled f LEFT JOIN (SELECT row_no, unnest(signals) AS signal,
  CAST(generate_subscripts(signals, 1) - 1 AS INTEGER) AS pos FROM sheet_signals) s
  ON s.row_no = f.row_no
WHERE group_name <> '' AND NOT group_is_can AND (signal IS NOT NULL OR f.row_no = group_no)""",
        "build_signal_dictionary": """
SELECT direction, node AS namespace, name AS message, signal,
  CASE WHEN frame_id < 65536 THEN printf('%04X', frame_id) ELSE printf('%X', frame_id) END
    AS msgid,
  CAST(start // 8 AS INTEGER) AS start_byte, CAST(start % 8 AS INTEGER) AS start_bit, length,
  trim(ten) AS choice_ten
FROM (SELECT *, row_number() OVER (PARTITION BY direction, node, name
  ORDER BY message_no DESC) AS nth FROM directions) d
LEFT JOIN bus_signals s ON s.message_no = d.message_no WHERE nth = 1""",
        "dictionary_round_trip": """
SELECT q.name || '__' || q.signal || '_' || q.direction || '_v' AS name, f.node AS namespace,
  f.name AS def_message, CASE WHEN f.frame_id < 65536 THEN printf('%04X', f.frame_id)
    ELSE printf('%X', f.frame_id) END AS msgid,
  CAST(f.start // 8 AS INTEGER) AS start_byte, CAST(f.start % 8 AS INTEGER) AS start_bit, f.length
FROM flat_dictionary q JOIN flat_dictionary f ON f.nth = 1 AND f.direction = q.direction
  AND lower(f.name) = lower(q.name) AND lower(f.signal) = lower(q.signal)""",
        "group_by_signal": """
SELECT query_signal, count(*) AS decoded_rows, count(match_value) AS "values",
  min(time) AS first_time, max(time) AS last_time FROM decoded_values GROUP BY 1""",
        "line_length_stats": """
SELECT CAST(min(length(value)) AS INTEGER) AS min_length,
  CAST(max(length(value)) AS INTEGER) AS max_length,
  CAST(greatest(150, least(min(length(value)) - 95, 700)) AS INTEGER) AS min_budget,
  CAST(greatest(150, least(max(length(value)) - 95, 700)) AS INTEGER) AS max_budget,
  CAST(ceil(count(*) / 8) AS BIGINT) AS batches FROM log_lines WHERE value LIKE '%Message%'""",
        "signal_count": "SELECT count(*) AS signals FROM dictionary",
        "distinct_nodes": "SELECT DISTINCT node FROM directions",
        "change_points": """
SELECT query_signal, ts, line_no, value FROM (SELECT *, lag(value) OVER w AS before,
  row_number() OVER w AS nth FROM points
  WINDOW w AS (PARTITION BY query_signal ORDER BY ts, line_no))
WHERE nth = 1 OR value IS DISTINCT FROM before""",
        "step_intervals": """
SELECT query_signal, ts, line_no, value, coalesce(lead(ts) OVER (PARTITION BY query_signal
  ORDER BY ts, line_no), last_ts) AS until
FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS nth,
  max(ts) OVER (PARTITION BY query_signal) AS last_ts FROM points
  WINDOW w AS (PARTITION BY query_signal ORDER BY ts, line_no))
WHERE nth = 1 OR value IS DISTINCT FROM before""",
        "signal_points": f"""
SELECT * FROM points WHERE ts BETWEEN {_WINDOW} - INTERVAL 6 HOUR
  AND {_WINDOW} + INTERVAL 6 HOUR""",
        "fill_message_rows":
            "SELECT row_no, group_no, group_name, group_is_can FROM sheet_filled",
        "batch_by_length": """
SELECT line_no, CAST(length AS INTEGER) AS length, batch, CAST(greatest(150, least(max(length) OVER (PARTITION BY batch)
  - 95, 700)) AS INTEGER) AS budget
FROM (SELECT line_no, length(value) AS length,
  (row_number() OVER (ORDER BY length(value), line_no) - 1) // 8 AS batch
  FROM log_lines WHERE value LIKE '%Message%')""",
        "first_match_per_key": """
SELECT service_id, method_id, line_no, file_path, time, type, payload FROM messages
QUALIFY row_number() OVER (PARTITION BY service_id, method_id ORDER BY line_no) = 1""",
        "last_match_per_key": """
SELECT time, type, service_id, method_id, place, payload FROM found_messages
QUALIFY row_number() OVER (PARTITION BY time, type, service_id, method_id
  ORDER BY place DESC) = 1""",
        "sort_by_length": """
SELECT line_no, file_path, value, CAST(length(value) AS INTEGER) AS length
FROM log_lines WHERE value LIKE '%Message%' ORDER BY length, line_no""",
        "sort_by_time_text": """
SELECT line_no, outcome, time, type, service_id, method_id, payload FROM read_replies
WHERE outcome = 'parsed' ORDER BY time, line_no""",
        "sorted_choice_keys": """
SELECT message_no, signal_no, '9,10' AS keys FROM bus_signals WHERE ten IS NOT NULL""",
        "shuffle_samples":
            "SELECT line_no, md5('42:' || line_no) AS draw FROM log_lines ORDER BY draw",
        "split_train_val": "SELECT line_no, split FROM split_rows",
        "quota_sample": """
SELECT line_no, stratum, place FROM (SELECT line_no, stratum, CAST(row_number() OVER (
    PARTITION BY stratum ORDER BY md5('42:' || line_no), line_no) AS INTEGER) AS place
  FROM (SELECT l.line_no, CASE WHEN l.kind = 'rx' AND k.type IS NOT NULL THEN 'rx_known'
      WHEN l.kind = 'rx' THEN 'rx_other' WHEN l.kind = 'tx' THEN 'tx_any' ELSE 'ignore' END
      AS stratum
    FROM labelled l LEFT JOIN known_pairs k ON k.type = l.kind
      AND k.service_id = l.service_id AND k.method_id = l.method_id))
WHERE place <= CASE stratum WHEN 'rx_known' THEN 400 WHEN 'rx_other' THEN 200
  WHEN 'tx_any' THEN 300 ELSE 200 END""",
        "example_per_type": f"""
SELECT kind, text FROM (SELECT kind, line_no, {_PROMPT.format('Parse the line.')} || answer
  AS text FROM labelled) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY line_no) = 1""",
        "union_property_results": """
SELECT l.query_signal, count(*) AS "rows", count(m.line_no) AS matches
FROM looked_up l LEFT JOIN messages m
  ON m.service_id IS NOT DISTINCT FROM l.service_id
  AND m.method_id IS NOT DISTINCT FROM l.method_id AND m.type = lower(l.direction)
WHERE l.found GROUP BY 1""",
        "union_directions": "SELECT * FROM directions",
        "payload_bytes": """
SELECT line_no, CAST(n AS INTEGER) AS bytes, array_to_string(b, ',') AS tokens FROM frames""",
        "frame_message_id": "SELECT line_no, upper(b[1] || b[2]) AS frame_id FROM frames",
        "frame_status_filter": "SELECT line_no, payload FROM frames WHERE b[3] = '01'",
        "extract_bits": "SELECT line_no, query_signal, decoded_bits, signal_value FROM decoded",
        "decode_skip_reason": """
SELECT line_no, sig_no, CASE
  WHEN upper(b[1] || b[2]) <> replace(upper(msgid), ' ', '') THEN 'id_mismatch'
  WHEN b[3] <> '01' THEN 'status_not_ok' WHEN 3 + start_byte >= n THEN 'short_start'
  WHEN length < 1 THEN 'bad_length'
  WHEN (3 + start_byte) * 8 + 7 - start_bit + length > n * 8 THEN 'short_bits'
  ELSE 'ok' END AS status
FROM frames JOIN definitions ON sig_no = (line_no // 3) % 6""",
        "choice_label": """
SELECT line_no, query_signal, match_label, match_status FROM decoded_values
WHERE cardinality(choices) > 0""",
        "scale_physical": "SELECT line_no, query_signal, physical_value FROM decoded",
        "range_check": """
SELECT line_no, query_signal, match_status FROM decoded_values WHERE cardinality(choices) = 0""",
        "expand_signal_array": """
SELECT row_no, CAST(generate_subscripts(signals, 1) - 1 AS INTEGER) AS position,
  unnest(signals) AS signal FROM sheet_signals""",
        "bit_position": """
SELECT m.message_no, signal_no,
  CASE WHEN frame_id < 65536 THEN printf('%04X', frame_id) ELSE printf('%X', frame_id) END
    AS msgid, CAST(start // 8 AS INTEGER) AS start_byte,
  CAST(start % 8 AS INTEGER) AS start_bit, trim(ten) AS choice_ten
FROM bus_messages m LEFT JOIN bus_signals s ON s.message_no = m.message_no""",
        "choice_index": """
SELECT line_no, query_signal, CASE WHEN match_label IS NULL THEN 0 ELSE signal_value END
  AS place FROM decoded_values WHERE cardinality(choices) > 0""",
        "normalise_unit": """
SELECT line_no, query_signal, CASE WHEN coalesce(maximum, 1.0) > coalesce(minimum, 0.0)
  THEN greatest(0.0, least(1.0, (match_value - coalesce(minimum, 0.0))
    / (coalesce(maximum, 1.0) - coalesce(minimum, 0.0)))) ELSE 0.0 END AS unit
FROM decoded_values WHERE match_value IS NOT NULL""",
        "score_in_batches": """
SELECT l.line_no, false AS failed, CASE WHEN m.type IS NULL THEN 'ignored' ELSE 'parsed' END
  AS outcome, coalesce(m.time, '') AS time, coalesce(m.type, 'ignore') AS type,
  m.service_id, m.method_id, m.payload
FROM log_lines l LEFT JOIN messages m ON m.line_no = l.line_no""",
        "score_log": """
SELECT l.line_no, false AS failed, CASE WHEN m.type IS NULL THEN 'ignored' ELSE 'parsed' END
  AS outcome, coalesce(m.time, '') AS time, coalesce(m.type, 'ignore') AS type,
  m.service_id, m.method_id, m.payload
FROM log_lines l LEFT JOIN messages m ON m.line_no = l.line_no
WHERE contains(value, 'SomeipCOmm :: RX Message') OR contains(value, 'TX Message SomeipComm::send')""",
        "score_log_counts": """
SELECT count(*) AS read_lines, count(*) FILTER (kept) AS kept_lines,
  count(*) FILTER (NOT kept) AS skipped_lines, count(*) FILTER (kept AND type IS NOT NULL) AS parsed,
  count(*) FILTER (kept AND type IS NULL) AS ignored, CAST(0 AS BIGINT) AS errors
FROM (SELECT m.type, contains(value, 'SomeipCOmm :: RX Message')
    OR contains(value, 'TX Message SomeipComm::send') AS kept
  FROM log_lines l LEFT JOIN messages m ON m.line_no = l.line_no)""",
        "stream_decoded_log":
            "SELECT time, query_signal, decoded_bits, match_value FROM decoded_values",
    }


def _all() -> dict[str, str]:
    from busweave.functions.replies import DEFAULT_INSTRUCTION

    texts = {name: _compose(sql) for name, sql in _selects().items()}
    texts["write_jsonl_split"] = texts["write_jsonl_split"].replace("@@", DEFAULT_INSTRUCTION)
    texts["window_with_continuations"] = _with(
        "", _SLICE + "\nSELECT file_path, line_no, ts, value FROM slice"
    )
    texts["decode_join"] = _with("matched routed", _analysis("matched"))
    windowed = """
, window_matched AS (
  SELECT l.*, g.line_no IS NOT NULL AS matched, g.line_no, g.time, g.payload
  FROM looked_up l LEFT JOIN (SELECT m.* FROM messages m JOIN slice USING (line_no)) g
    ON g.service_id IS NOT DISTINCT FROM l.service_id
    AND g.method_id IS NOT DISTINCT FROM l.method_id AND g.type = lower(l.direction)
  WHERE l.found)"""
    texts["analyze_properties"] = _with(
        "routed", _SLICE + windowed + _analysis("window_matched")
    )
    return texts


ORACLE_SQL = _all()
