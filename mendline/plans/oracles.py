"""For each query the SQL (DuckDB) that must give the same rows from the same tables.

Written independently of the Spark code: plain windows per record, no stretches, no carried values.
"""

# Tagged rows. `f` is the variant in which fills of low value report a failure.
_INPUT = """
e AS (SELECT user_id AS record_id, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'G' WHEN 'signup' THEN 'F' ELSE 'N' END AS kind,
    CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    event_type, value, props, event_id AS id,
    CASE event_type WHEN 'error' THEN 'G' WHEN 'purchase' THEN 'X' WHEN 'signup' THEN NULL ELSE 'N' END AS type FROM events),
b AS (SELECT *, CASE WHEN kind = 'F' THEN ts - k * 3600000 END AS cutoff, true AS ok, props AS payload, ts AS rec_ts FROM e),
f AS (SELECT record_id, seq, id, kind, ts, rec_ts, k, event_type, type, value, props,
    CASE WHEN kind = 'F' AND value < 5.0 THEN -1 ELSE cutoff END AS cutoff,
    kind <> 'F' OR value >= 5.0 AS ok,
    CASE WHEN kind = 'F' AND value < 5.0 THEN '{}' ELSE props END AS payload FROM b)"""


_PAYLOAD = """'{"k":' || k || '}'"""


def _wire(faulty: bool, strict: bool) -> str:
    """The rows as they come over the wire: `w`, with their place in order of arrival as `seq`."""
    bad = "7, 17, 27, 47, 57" + (", 37" if strict else "")
    fine = f"WHERE CASE WHEN kind = 'F' THEN k <> 7 ELSE k NOT IN ({bad}) END" if faulty else ""
    return f""",
q AS (SELECT * REPLACE (CASE WHEN kind = 'F' THEN CASE WHEN k < 50 THEN cutoff >= 0 ELSE value >= 5.0 END ELSE ok END AS ok,
    CASE WHEN id % 10 = 3 THEN ts - 432000000 ELSE ts END AS rec_ts, {_PAYLOAD} AS payload),
    CASE WHEN kind = 'F' THEN 1 ELSE 0 END AS rank, CASE WHEN kind = 'F' THEN id - 1 ELSE id END AS off,
    CASE WHEN kind <> 'F' AND k = 37 AND {faulty} THEN record_id || 'x' ELSE CAST(record_id AS VARCHAR) END AS key FROM b {fine}),
a AS (SELECT *, max(rec_ts) OVER (PARTITION BY record_id, rank ORDER BY off ROWS UNBOUNDED PRECEDING) AS arrived FROM q),
w AS (SELECT * REPLACE (row_number() OVER (PARTITION BY record_id ORDER BY arrived, rank, off) AS seq) FROM a)"""


def _decided(source: str = "b", strict: bool = False, faulty: bool = False, forced: str = "false") -> str:
    """CTEs ending in `d`: each row with its decision. Source `w`: over the wire."""
    wire = _wire(faulty, strict) if source == "w" else ""
    failed_fill = "WHEN kind = 'F' AND NOT ok THEN 'fill_error'" if strict else ""
    failed_row = "WHEN NOT close_ok THEN 'dead_letter'" if strict else ""
    return f"""WITH {_INPUT}{wire},
x AS (SELECT *,
    coalesce(last_value(CASE WHEN kind <> 'N' THEN kind END IGNORE NULLS) OVER prior = 'G', false) AS in_gap,
    first_value(CASE WHEN kind = 'F' THEN cutoff END IGNORE NULLS) OVER later AS close_cutoff,
    first_value(CASE WHEN kind = 'F' THEN ok END IGNORE NULLS) OVER later AS close_ok,
    first_value(CASE WHEN kind = 'F' THEN seq END IGNORE NULLS) OVER later AS close_seq,
    first_value(CASE WHEN kind = 'F' THEN rec_ts END IGNORE NULLS) OVER later AS close_at
  FROM {source}
  WINDOW prior AS (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (PARTITION BY record_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, CASE {failed_fill}
    WHEN kind = 'G' AND in_gap THEN 'gap_dropped' WHEN kind = 'G' THEN 'command'
    WHEN kind = 'F' AND in_gap THEN 'filled' WHEN kind = 'F' AND {forced} THEN 'forced' WHEN kind = 'F' THEN 'fill_ignored'
    WHEN NOT in_gap THEN 'forwarded' WHEN close_seq IS NULL THEN 'pending' {failed_row}
    WHEN ts > close_cutoff THEN 'flushed' ELSE 'dropped' END AS decision FROM x)
"""


_ROWS = "SELECT record_id, seq, decision FROM d"
_COMMANDS = """c AS (SELECT record_id, 'User' AS entity_type, CAST(seq AS VARCHAR) AS event_id, seq, ts, k
    FROM d WHERE decision = 'command')"""
_IMAGES = """i AS (SELECT c_custkey AS rid, version, c_mktsegment, c_acctbal >= 0 OR version = 1 AS is_json,
    CASE WHEN c_mktsegment <> 'FURNITURE' AND (c_acctbal >= 0 OR version = 1)
      THEN 1704067200000 + ((c_custkey * 7919) % 720) * 3600000 - version * 86400000 END AS modified, c_name || '-' || version AS name
    FROM customer, (SELECT unnest([0, 1]) AS version) WHERE c_mktsegment <> 'MACHINERY' AND (version = 0 OR c_custkey % 2 = 0))"""
# The current image of each record: the newest, usable or not. `normal`: its fields in order of their names.
_SNAPSHOT = _IMAGES + """, s AS (SELECT rid, modified AS cut, is_json, name FROM i WHERE version = 0)"""
_LOOKUP = _decided() + f", {_COMMANDS}, {_SNAPSHOT}" + """, l AS (SELECT record_id, entity_type, event_id, seq,
    coalesce(cut, -1) AS cutoff, cut IS NOT NULL AS is_success,
    CASE WHEN cut IS NULL THEN '{}' ELSE '{"name":"' || name || '","lastModifiedEpochMs":' || cut || '}' END AS all_fields,
    CASE WHEN cut IS NULL THEN '{}' ELSE '{"lastModifiedEpochMs":' || cut || ',"name":"' || name || '"}' END AS normal,
    CASE WHEN cut IS NOT NULL THEN '' WHEN rid IS NULL THEN 'not found: /' || entity_type || '/' || record_id
         WHEN NOT is_json THEN 'bad image: /' || entity_type || '/' || record_id ELSE 'bad modification time: n/a' END AS err
    FROM c LEFT JOIN s ON record_id = rid) """
_OLDER_EVENT = """'{"recordId":"' || record_id || '","entityType":"User","eventId":"' || event_id || '","cutoffLastModifiedEpochMs":'
      || cutoff || ',"allFields":' || normal || '}'"""
_FILL_EVENT = """'{"recordId":"' || record_id || '","entityType":"User","eventId":"' || event_id || '","cutoffLastModifiedEpochMs":'
      || cutoff || ',"allFields":' || normal || ',"isSuccess":' || CASE WHEN is_success THEN 'true' ELSE 'false' END
      || ',"errMessage":"' || err || '"}'"""
_FAULTS = f"""WITH {_INPUT}, w AS (SELECT seq AS rec_offset,
    CASE k WHEN 57 THEN NULL WHEN 37 THEN record_id || 'x' ELSE CAST(record_id AS VARCHAR) END AS key,
    CASE WHEN k NOT IN (7, 47) THEN CAST(seq AS VARCHAR) END AS event_id,
    CASE WHEN k NOT IN (7, 17, 47) THEN CAST(record_id AS VARCHAR) END AS record_id,
    CASE WHEN k NOT IN (7, 27, 47) THEN type END AS type,
    CASE k WHEN 57 THEN 'null_key' WHEN 47 THEN 'null_value' WHEN 7 THEN 'bad_json' WHEN 17 THEN 'null_record_id'
        WHEN 27 THEN 'null_type' WHEN 37 THEN 'key_mismatch' ELSE 'ok' END AS problem
    FROM e WHERE kind <> 'F') """
_ATTEMPTS = _decided() + """, a AS (SELECT record_id, 'User' AS entity_type, seq, ts,
    CASE WHEN k < 10 THEN '404' WHEN k < 30 THEN '503' WHEN k < 40 THEN 'timeout' ELSE '200' END AS status,
    CASE WHEN k < 10 THEN 'permanent' WHEN k < 40 THEN 'transient' ELSE 'success' END AS outcome
    FROM d WHERE decision = 'command'),
r AS (SELECT *, coalesce(sum(CASE WHEN outcome <> 'transient' THEN 1 ELSE 0 END) OVER (ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a) """
_COUNTED = """n AS (SELECT
    count(*) FILTER (kind <> 'F') AS received, count(*) FILTER (decision = 'forwarded') AS forwarded,
    count(*) FILTER (decision = 'dropped') AS dropped, count(*) FILTER (decision = 'flushed') AS flushed,
    count(*) FILTER (decision IN ('flushed', 'dropped', 'pending')) AS buffered,
    count(*) FILTER (decision = 'filled') AS filled, count(*) FILTER (kind = 'G') AS detected,
    count(*) FILTER (decision = 'gap_dropped') AS gap_dropped, count(*) FILTER (decision = 'command') AS command,
    count(*) FILTER (kind = 'F') AS fills FROM d)"""


def _output(strict: bool) -> str:
    order = "seq" if strict else "seq DESC"
    made = "('filled')"
    return _decided("f", strict) + f""", p AS (SELECT *, row_number() OVER (PARTITION BY record_id, close_seq, decision
        ORDER BY {order}) AS pos FROM d WHERE decision IN ('forwarded', 'filled', 'flushed'))
    SELECT record_id, CASE WHEN decision = 'flushed' THEN close_seq ELSE seq END AS out_seq,
      CASE WHEN decision = 'flushed' THEN pos ELSE 0 END AS out_pos, seq, coalesce(type, kind) AS type,
      CASE WHEN decision = 'flushed' THEN close_at ELSE ts END AS rec_ts, CASE WHEN kind = 'F' THEN 0 ELSE seq END AS replay_id,
      CAST(NULL AS BIGINT) AS gap_from, CAST(NULL AS BIGINT) AS gap_to, CAST(NULL AS VARCHAR) AS gap_reason,
      {"CAST(seq AS VARCHAR)" if strict else "CASE WHEN kind = 'F' THEN NULL ELSE CAST(seq AS VARCHAR) END"} AS event_id,
      {"'User'" if strict else "CASE WHEN kind = 'F' THEN CAST(record_id AS VARCHAR) ELSE 'User' END"} AS entity,
      CASE WHEN kind = 'F' THEN {"cutoff" if strict else "NULL"} ELSE ts END AS ts, payload FROM p"""


def _synthetic(strict: bool) -> str:
    return _decided("f", strict) + f"""SELECT record_id, seq, 'F' AS type,
      {"'User'" if strict else "CAST(record_id AS VARCHAR)"} AS entity,
      {"CAST(seq AS VARCHAR)" if strict else "CAST(NULL AS VARCHAR)"} AS event_id,
      {"cutoff" if strict else "CAST(NULL AS BIGINT)"} AS ts, payload FROM d WHERE decision = 'filled'"""


def _replay(strict: bool) -> str:
    return _decided("b", strict) + f"""SELECT record_id, close_seq, seq, row_number() OVER (
      PARTITION BY record_id, close_seq ORDER BY seq {"" if strict else "DESC"}) AS pos
      FROM d WHERE decision = 'flushed'"""


def _retries(doubling: bool) -> str:
    delay = "least(60000, 1000 * CAST(pow(2, least(attempt - 1, 6)) AS BIGINT))" if doubling else "1000"
    return _ATTEMPTS + f""", t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS attempt
      FROM r WHERE outcome = 'transient'),
    y AS (SELECT *, CAST({delay} AS BIGINT) AS delay_ms FROM t)
    SELECT record_id, entity_type, seq, attempt, delay_ms, greatest(0, delay_ms
      + ((seq % 1000003) * 7919) % (2 * CAST(floor(delay_ms * 0.2) AS BIGINT) + 1)
      - CAST(floor(delay_ms * 0.2) AS BIGINT)) AS jittered_ms FROM y"""


def _limited(timeout_ms: int | None, max_buffer: int | None) -> str:
    """Row by row per record: the open gap and its size are carried from row to row, as numbers alone. Ends in `d`."""
    expired = f"(s.opened_at IS NOT NULL AND r.ts > s.opened_at + {timeout_ms})" if timeout_ms else "false"
    over = f"s.n + 1 > {max_buffer}" if max_buffer else "false"
    return f"""WITH RECURSIVE {_INPUT},
r AS (SELECT record_id, seq, ts, CASE kind WHEN 'F' THEN 1 WHEN 'G' THEN 2 ELSE 3 END AS kind,
    row_number() OVER (PARTITION BY record_id ORDER BY seq) AS rn FROM b),
st AS (
  SELECT record_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS opened_at,
    CAST(NULL AS BIGINT) AS open_seq, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS expired_seq,
    CAST(NULL AS BIGINT) AS acted_seq, CAST(NULL AS BIGINT) AS act
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.record_id, r.rn, r.seq,
    CASE WHEN r.kind = 1 THEN NULL WHEN r.kind = 2 THEN CASE WHEN s.opened_at IS NULL OR {expired} THEN r.ts ELSE s.opened_at END
      WHEN s.opened_at IS NULL OR {expired} OR {over} THEN NULL ELSE s.opened_at END,
    CASE WHEN r.kind = 1 THEN NULL WHEN r.kind = 2 THEN CASE WHEN s.opened_at IS NULL OR {expired} THEN r.seq ELSE s.open_seq END
      WHEN s.opened_at IS NULL OR {expired} OR {over} THEN NULL ELSE s.open_seq END,
    CASE WHEN r.kind = 3 AND s.opened_at IS NOT NULL AND NOT {expired} THEN s.n + 1
      WHEN r.kind = 2 AND s.opened_at IS NOT NULL AND NOT {expired} THEN s.n ELSE 0 END,
    CASE WHEN {expired} THEN s.open_seq END,
    CASE WHEN s.opened_at IS NOT NULL AND NOT {expired} THEN s.open_seq END,
    CASE WHEN s.opened_at IS NULL OR {expired} THEN r.kind
      ELSE CASE WHEN r.kind < 3 THEN 3 + r.kind WHEN {over} THEN 6 ELSE 7 END END
  FROM st s JOIN r ON r.record_id = s.record_id AND r.rn = s.rn + 1),
ends AS (
  SELECT record_id, expired_seq AS open_seq, 1 AS why, CAST(NULL AS BIGINT) AS cutoff, CAST(NULL AS BIGINT) AS end_seq,
    CAST(NULL AS BIGINT) AS end_at FROM st WHERE expired_seq IS NOT NULL
  UNION ALL SELECT record_id, acted_seq, 2, NULL, NULL, NULL FROM st WHERE act = 6
  UNION ALL SELECT st.record_id, acted_seq, 3, cutoff, st.seq, ts FROM st JOIN b USING (record_id, seq) WHERE act = 4),
d AS (SELECT b.*, CASE act WHEN 1 THEN 'fill_ignored' WHEN 2 THEN 'command' WHEN 3 THEN 'forwarded' WHEN 4 THEN 'filled' WHEN 5 THEN 'gap_dropped' ELSE
    CASE WHEN why IS NULL THEN 'pending'
    WHEN why <> 3 THEN 'dead_letter' WHEN b.ts > ends.cutoff THEN 'flushed' ELSE 'dropped' END END AS decision, expired_seq,
    end_seq, end_at, acted_seq
  FROM st JOIN b USING (record_id, seq)
  LEFT JOIN ends ON ends.record_id = st.record_id AND ends.open_seq = st.acted_seq AND act IN (6, 7)),
g AS (SELECT c.record_id, c.seq AS open_seq, 'User' AS entity, CAST(c.seq AS VARCHAR) AS event_id, why
  FROM d c JOIN ends ON ends.record_id = c.record_id AND ends.open_seq = c.seq WHERE why <> 3)
"""


def _event_json(entity: str, event_id: str, ts: str, type_: str, replay: str, fields: str) -> str:
    """A change event as text; `event_id`, `ts` and `replay` are SQL for JSON values."""
    return f"""'{{"eventId":' || {event_id} || ',"entity":"' || {entity} || '","recordId":"' || record_id
      || '","type":"' || {type_} || '","timestamp":' || {ts} || ',"replayId":' || {replay}
      || ',"changedFields":' || {fields} || ',"gap":null}}'"""


_ID = "'\"' || id || '\"'"
_COMMAND_JSON = """'{"recordId":"' || record_id || '","entityType":"User","eventId":"' || id || '"}'"""
_CHANGE_JSON = _event_json("'User'", _ID, "ts", "type", "id", _PAYLOAD)
_FILL_JSON = _event_json("record_id", "'null'", "'null'", "'F'", "'0'", _PAYLOAD)
_FILL_JSON_STRICT = _event_json("'User'", _ID, "cutoff", "'F'", "'0'", _PAYLOAD)
_ERROR_JSON = f"""'{{"recordId":"' || record_id || '","entityType":"User","eventId":"' || id || '","reason":"' || decision
      || '","errMessage":' || CASE WHEN kind = 'F' THEN '"no image"' ELSE 'null' END || ',"fields":' || {_PAYLOAD} || '}}'"""
# A change as it comes in, with the faults of the wire.
_WIRE_JSON = f"""'{{"eventId":"' || id || '","entity":"User","recordId":' || CASE k WHEN 17 THEN 'null' ELSE '"' || record_id || '"' END
      || ',"type":' || CASE k WHEN 27 THEN 'null' ELSE '"' || type || '"' END || ',"timestamp":' || ts || ',"replayId":' || id
      || ',"changedFields":' || {_PAYLOAD} || ',"gap":' || CASE WHEN kind = 'G' THEN '{{"fromReplayId":' || id || ',"toReplayId":'
      || (id + 1) || ',"reason":"missed"}}' ELSE 'null' END || '}}'"""
_FILL_START = """'{"recordId":"' || record_id || '","entityType":"User","eventId":"' || id || '","cutoff'"""


def _routed(strict: bool, faulty: bool) -> str:
    """All that the gap handler sends, numbered per record in order of emission."""
    bad = "7, 17, 27, 47, 57" + (", 37" if strict else "")
    rejected = f"""
      UNION ALL SELECT 'ERROR', CASE k WHEN 57 THEN NULL WHEN 37 THEN record_id || 'x' ELSE CAST(record_id AS VARCHAR) END AS key,
        '{{"recordId":' || coalesce('"' || (CASE k WHEN 57 THEN NULL WHEN 37 THEN record_id || 'x' ELSE CAST(record_id AS VARCHAR) END) || '"', 'null')
        || ',"reason":"' || (CASE k WHEN 57 THEN 'null_key' WHEN 47 THEN 'null_value' WHEN 7 THEN 'bad_json' WHEN 17 THEN 'null_record_id'
          WHEN 27 THEN 'null_type' ELSE 'key_mismatch' END) || '","text":'
        || coalesce(CAST(to_json(CASE k WHEN 47 THEN NULL WHEN 7 THEN substring(text, 1, 40) ELSE text END) AS VARCHAR), 'null') || '}}',
        CASE WHEN id % 10 = 3 THEN ts - 432000000 ELSE ts END, CASE WHEN kind = 'F' THEN id - 1 ELSE id END
      FROM (SELECT *, CASE WHEN kind = 'F' THEN {_FILL_START} ELSE {_WIRE_JSON} END AS text FROM e
        WHERE CASE WHEN kind = 'F' THEN k = 7 ELSE k IN ({bad}) END)""" if faulty else ""
    return _decided("w", strict, faulty) + f""", m AS (SELECT *, CASE WHEN decision IN ('flushed', 'dead_letter') THEN close_seq ELSE seq END AS cause,
        CASE WHEN decision IN ('flushed', 'dead_letter') THEN {"seq" if strict else "-seq"} ELSE NULL END AS nth
      FROM d WHERE decision IN ('forwarded', 'filled', 'flushed', 'command', 'fill_error', 'dead_letter')),
      n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY cause, nth NULLS FIRST) AS place FROM m)
      SELECT CASE decision WHEN 'command' THEN 'CDC-FILL-COMMAND' WHEN 'fill_error' THEN 'ERROR' WHEN 'dead_letter' THEN 'ERROR'
          ELSE 'CDC-OUTPUT' END AS topic,
        CASE WHEN decision IN ('flushed', 'dead_letter') THEN CAST(record_id AS VARCHAR) ELSE key END AS key,
        CASE WHEN decision = 'command' THEN {_COMMAND_JSON} WHEN decision = 'filled' THEN {_FILL_JSON_STRICT if strict else _FILL_JSON}
          WHEN decision IN ('fill_error', 'dead_letter') THEN {_ERROR_JSON} ELSE {_CHANGE_JSON} END AS value,
        CASE WHEN decision IN ('flushed', 'dead_letter') THEN close_at ELSE rec_ts END AS rec_ts, place AS rec_offset FROM n{rejected}"""


def _wire_decisions(strict: bool, forced: str = "false") -> str:
    bad = "7, 17, 27, 47, 57" + (", 37" if strict else "")
    return _decided("w", strict, True, forced) + f"""SELECT CAST(record_id AS VARCHAR) AS record_id, rank AS source_rank, off AS rec_offset, decision FROM d
      UNION ALL SELECT CASE WHEN k IN (27, 37, 57) THEN CAST(record_id AS VARCHAR) END, 0, id, 'invalid' FROM e
        WHERE kind <> 'F' AND k IN ({bad})
      UNION ALL SELECT NULL, 1, id - 1, 'fill_invalid' FROM e WHERE kind = 'F' AND k = 7"""


# Counts over the faulty wire, with the rows that can't be used.
_WIRE_COUNTED = _decided("w", faulty=True) + f""", {_COUNTED.replace("n AS (", "n0 AS (")},
    u AS (SELECT count(*) FILTER (kind <> 'F' AND k IN (7, 17, 27, 47, 57)) AS invalid_events,
      count(*) FILTER (kind = 'F' AND k = 7) AS invalid_fills FROM e),
    n AS (SELECT * REPLACE (received + invalid_events AS received, fills + invalid_fills AS fills) FROM n0, u)"""


# Reasons are numbers inside the SQL.
_WHY = "CASE why WHEN 1 THEN 'timeout' ELSE 'overflow' END"
_LIMITS = _limited(48 * 3600000, 2)

ORACLES: dict[str, str] = {
    "cdc_source_parse": f"""WITH {_INPUT} SELECT CAST(record_id AS VARCHAR) AS key, CASE WHEN id % 10 = 3 THEN ts - 432000000 ELSE ts END AS rec_ts,
      seq AS rec_offset, CAST(seq AS VARCHAR) AS event_id, 'User' AS entity, CAST(record_id AS VARCHAR) AS record_id, type, ts,
      seq AS replay_id, {_PAYLOAD} AS payload, CASE WHEN kind = 'G' THEN seq END AS gap_from,
      CASE WHEN kind = 'G' THEN seq + 1 END AS gap_to, CASE WHEN kind = 'G' THEN 'missed' END AS gap_reason
      FROM e WHERE kind <> 'F'""",
    "tagged_union_input": f"""WITH {_INPUT}{_wire(False, False)} SELECT CAST(record_id AS VARCHAR) AS record_id, key, rec_ts, arrived,
      rank AS source_rank, off AS rec_offset, off * 2 + rank AS seq, kind, type, CAST(id AS VARCHAR) AS event_id, 'User' AS entity,
      CASE WHEN kind <> 'F' THEN ts END AS ts, CASE WHEN kind <> 'F' THEN id END AS replay_id,
      CASE WHEN kind = 'G' THEN id END AS gap_from, CASE WHEN kind = 'G' THEN id + 1 END AS gap_to,
      CASE WHEN kind = 'G' THEN 'missed' END AS gap_reason, payload, cutoff, kind = 'F' AND ok AS ok,
      CASE WHEN kind = 'F' AND k >= 50 THEN CASE WHEN value >= 5.0 THEN '' ELSE 'no image' END END AS err FROM w""",
    "json_decode_quarantine": _FAULTS + "SELECT rec_offset, event_id, record_id, type, problem FROM w",
    "json_encode": f"""WITH {_INPUT} SELECT seq AS rec_offset, CAST(record_id AS VARCHAR) AS key,
      '{{"eventId":"' || seq || '","entity":"User","recordId":"' || record_id || '","type":"' || type
      || '","timestamp":' || ts || ',"replayId":' || seq || ',"changedFields":' || {_PAYLOAD} || ',"gap":'
      || CASE WHEN kind = 'G' THEN '{{"fromReplayId":' || seq || ',"toReplayId":' || (seq + 1)
         || ',"reason":"missed"}}' ELSE 'null' END || '}}' AS value FROM e WHERE kind <> 'F'""",
    "fill_events_out": _LOOKUP + f"SELECT CAST(record_id AS VARCHAR) AS key, {_FILL_EVENT} AS value FROM l",
    "valid_records": _FAULTS + """SELECT rec_offset, key, record_id, type FROM w
      WHERE key IS NOT NULL AND record_id IS NOT NULL""",
    "gap_events": _FAULTS + "SELECT rec_offset, record_id, event_id FROM w WHERE type = 'G'",
    "key_mismatch": _FAULTS + "SELECT rec_offset, key, record_id FROM w WHERE key <> record_id",
    "in_gap_flag": _decided() + "SELECT record_id, seq, kind, in_gap FROM d",
    "gap_decisions": _decided() + _ROWS,
    "gap_decisions_split": _decided() + _ROWS,
    "gap_decisions_failing": _decided("f") + _ROWS,
    "gap_decisions_strict": _decided("f", strict=True) + _ROWS,
    "gap_decisions_filtered": _decided() + _ROWS,
    "gap_decisions_filtered_strict": _decided("f", strict=True) + _ROWS,
    "forwarded_events": _decided() + """SELECT record_id, seq, type, CAST(seq AS VARCHAR) AS event_id, 'User' AS entity,
      ts, rec_ts, seq AS replay_id, CAST(NULL AS BIGINT) AS gap_from, CAST(NULL AS BIGINT) AS gap_to, CAST(NULL AS VARCHAR) AS gap_reason,
      payload FROM d WHERE decision = 'forwarded'""",
    "fill_commands": _decided() + f", {_COMMANDS} SELECT record_id, entity_type, event_id, seq FROM c",
    "synthetic_fill_rows": _synthetic(strict=False),
    "synthetic_fill_rows_strict": _synthetic(strict=True),
    "flushed_vs_dropped": _decided() + """SELECT record_id, seq, ts, close_seq, close_cutoff, decision FROM d
      WHERE decision IN ('flushed', 'dropped')""",
    "demux_outputs": _decided("f", strict=True) + """SELECT record_id, seq, CASE
      WHEN decision = 'command' THEN 'CDC-FILL-COMMAND' WHEN decision IN ('fill_error', 'dead_letter') THEN 'ERROR'
      ELSE 'CDC-OUTPUT' END AS output FROM d WHERE decision NOT IN ('gap_dropped', 'dropped', 'pending', 'fill_ignored')""",
    # Full case mapping, as in Java: the sharp s has the capital form SS, which DuckDB's upper leaves out.
    "map_values_upper": "SELECT doc_id AS id, upper(replace(text, 'ß', 'ss')) AS payload FROM documents",
    "dedupe_monotonic": f"""WITH {_INPUT}, t AS (SELECT record_id, seq, coalesce(cutoff, ts) AS ts FROM b),
      m AS (SELECT *, max(ts) OVER (PARTITION BY record_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t)
      SELECT record_id, seq, ts FROM m WHERE last IS NULL OR ts > last""",
    "cdc_output": _output(strict=False),
    "cdc_output_split": _output(strict=False),
    "cdc_output_strict": _output(strict=True),
    "cdc_output_filtered": _output(strict=False),
    "cdc_output_filtered_strict": _output(strict=True),
    "replay_order": _replay(strict=False),
    "replay_order_strict": _replay(strict=True),
    "error_sink": _decided("f", strict=True) + """SELECT record_id, seq, kind, decision,
      CASE WHEN decision = 'dead_letter' THEN close_seq END AS cause_seq,
      CASE WHEN kind = 'F' THEN 'no image' END AS message, payload
      FROM d WHERE decision IN ('fill_error', 'dead_letter')""",
    "fill_lookup_left": _LOOKUP + "SELECT * EXCLUDE (normal) FROM l",
    "fill_lookup_inner": _LOOKUP + "SELECT record_id, entity_type, event_id, seq, cutoff, all_fields FROM l WHERE is_success",
    "fill_lookup_misses": _LOOKUP + """SELECT record_id, entity_type, event_id, seq,
      '/' || entity_type || '/' || record_id AS path FROM l WHERE err LIKE 'not found%'""",
    "fill_lookup_as_of": _decided() + f", {_COMMANDS}, {_IMAGES}" + """,
      v AS (SELECT rid, version, is_json, modified, name, 1704067200000 + ((rid * 7919) % 720) * 3600000 - version * 86400000 AS taken FROM i),
      p AS (SELECT c.*, (SELECT max(taken) FROM v WHERE rid = record_id AND taken <= ts + 12 * 3600000) AS last_taken FROM c),
      q AS (SELECT p.*, rid, is_json, modified, name, coalesce(modified >= ts, false) AS good FROM p LEFT JOIN v ON rid = record_id AND taken = last_taken)
      SELECT record_id, entity_type, event_id, seq, CASE WHEN good THEN modified ELSE -1 END AS cutoff,
        CASE WHEN good THEN '{"name":"' || name || '","lastModifiedEpochMs":' || modified || '}' ELSE '{}' END AS all_fields, good AS is_success,
        CASE WHEN good THEN '' WHEN rid IS NULL THEN 'not found: /' || entity_type || '/' || record_id
          WHEN NOT is_json THEN 'bad image: /' || entity_type || '/' || record_id WHEN modified IS NULL THEN 'bad modification time: n/a'
          ELSE 'stale image: /' || entity_type || '/' || record_id END AS err FROM q""",
    "fill_commands_fanout": _LOOKUP + """, o AS (SELECT record_id, event_id, modified AS cutoff, true AS is_success, seq * 2 + CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS place
        FROM c JOIN i ON record_id = rid WHERE version = 1 AND modified IS NOT NULL),
      b2 AS (SELECT record_id, event_id, cutoff, is_success, seq * 2 AS place FROM l UNION ALL SELECT * FROM o)
      SELECT record_id, event_id, cutoff, is_success FROM b2
      QUALIFY row_number() OVER (PARTITION BY record_id, event_id ORDER BY is_success DESC, place) = 1""",
    "gap_fill_episodes": _decided() + """, o AS (SELECT record_id, seq AS open_seq,
        row_number() OVER (PARTITION BY record_id ORDER BY seq) AS episode, close_seq, close_cutoff AS cutoff
      FROM d WHERE decision = 'command')
      SELECT o.record_id, episode, open_seq, o.close_seq, o.cutoff,
        count(*) FILTER (decision = 'gap_dropped') AS n_gap_dropped, count(*) FILTER (d.kind = 'N') AS n_buffered,
        count(*) FILTER (decision = 'flushed') AS n_flushed, count(*) FILTER (decision = 'dropped') AS n_dropped,
        count(*) FILTER (decision = 'pending') AS n_pending, count(*) FILTER (decision = 'dead_letter') AS n_dead_letter
      FROM o LEFT JOIN d ON d.record_id = o.record_id AND d.seq >= open_seq
        AND (o.close_seq IS NULL OR d.seq <= o.close_seq)
      GROUP BY ALL""",
    "ignored_fills": _decided() + "SELECT record_id, seq, cutoff FROM d WHERE decision = 'fill_ignored'",
    "pending_buffer": _decided() + "SELECT record_id, seq, ts, payload FROM d WHERE decision = 'pending'",
    "gap_counters": _WIRE_COUNTED + " SELECT received AS events_received, forwarded AS events_forwarded, dropped AS buffered_events_dropped, flushed AS buffered_events_flushed, buffered AS events_buffered, filled AS gap_events_filled, detected AS gap_event_detected, gap_dropped AS gap_event_dropped, command AS fill_commands_published, CAST(0 AS BIGINT) AS fill_commands_timeout, fills AS fill_event_received, (SELECT invalid_events FROM u) AS invalid_events, (SELECT invalid_fills FROM u) AS invalid_fills FROM n",
    "gap_counter_report": _WIRE_COUNTED + f"""
      SELECT name, CAST(value AS DOUBLE) AS value FROM (
        SELECT 'cdc.events.received' AS name, received AS value FROM n
        UNION ALL SELECT 'cdc.events.forwarded', forwarded FROM n
        UNION ALL SELECT 'cdc.buffered-events.dropped', dropped FROM n
        UNION ALL SELECT 'cdc.buffered-events.flushed', flushed FROM n
        UNION ALL SELECT 'cdc.events.buffered', buffered FROM n
        UNION ALL SELECT 'cdc.gap-events.filled', filled FROM n
        UNION ALL SELECT 'cdc.gap-event.detected', detected FROM n
        UNION ALL SELECT 'cdc.gap-event.dropped', gap_dropped FROM n
        UNION ALL SELECT 'cdc.fill-commands.published', command FROM n
        UNION ALL SELECT 'cdc.fill-commands.timeout', 0 FROM n
        UNION ALL SELECT 'cdc.fill-event.received', fills FROM n
        UNION ALL SELECT 'NOT_NORMAL', received - forwarded FROM n
        UNION ALL SELECT 'GAP_DETECTED_OR_BUFFERED', detected + buffered FROM n
        UNION ALL SELECT 'NOT_NORMAL=GAP_DETECTED_OR_BUFFERED',
          CASE WHEN received - forwarded = detected + buffered THEN 1 ELSE 0 END FROM n) ORDER BY name""",
    "gap_conservation": _WIRE_COUNTED + """ SELECT received - forwarded AS not_normal, detected + buffered AS detected_or_buffered,
      (SELECT invalid_events FROM u) AS invalid_events, received - forwarded = detected + buffered AS balanced,
      received - forwarded - (SELECT invalid_events FROM u) = detected + buffered AS balanced_valid FROM n""",
    "buffer_per_episode": _decided() + """, u AS (SELECT *, sum(CASE WHEN kind = 'F' THEN 1 ELSE 0 END)
        OVER (PARTITION BY record_id ORDER BY seq) AS epoch FROM d)
      SELECT record_id, count(*) AS n_buffered, min(seq) AS first_seq, max(seq) AS last_seq, max(ts) AS last_ts
      FROM u WHERE decision IN ('flushed', 'dropped', 'pending') GROUP BY record_id, epoch""",
    "current_state": """SELECT user_id AS record_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type,
      arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY user_id""",
    "materialized_image": _decided() + """, o AS (SELECT record_id, seq, kind, event_type, k, value,
        CASE WHEN decision = 'flushed' THEN close_seq ELSE seq END AS out_seq,
        CASE WHEN decision = 'flushed' THEN -seq END AS out_pos
      FROM d WHERE decision IN ('forwarded', 'filled', 'flushed')),
      q AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY out_seq, out_pos NULLS FIRST) AS rn FROM o),
      z AS (SELECT *, coalesce(max(CASE WHEN kind = 'F' THEN rn END) OVER (PARTITION BY record_id), 0) AS full_rn FROM q)
      SELECT record_id, arg_max(event_type, rn) FILTER (event_type = 'signup' AND rn >= full_rn) AS event_type,
        arg_max(k, rn) FILTER (event_type IN ('signup', 'click', 'purchase') AND rn >= full_rn) AS k,
        arg_max(value, rn) FILTER (event_type IN ('signup', 'view', 'purchase') AND rn >= full_rn) AS value
      FROM z GROUP BY record_id""",
    "distinct_records": "SELECT user_id AS record_id, min(event_id) AS first_seq FROM events GROUP BY user_id ORDER BY 2",
    "record_count": "SELECT count(DISTINCT user_id) AS n_records FROM events",
    "replay_gaps": f"""WITH {_INPUT}, t AS (SELECT DISTINCT ts // 1000 AS s FROM e), i AS (SELECT s, lag(s) OVER (ORDER BY s) AS prev FROM t)
      SELECT prev + 1 AS from_id, s - 1 AS to_id, s - prev - 1 AS n_missing FROM i WHERE s - prev > 1""",
    "change_capture": f"""WITH {_INPUT}, v AS (SELECT record_id, seq, ts AS modified, event_type, k, value,
        lag(seq) OVER w AS old_seq, lag(event_type) OVER w AS old_type, lag(k) OVER w AS old_k, lag(value) OVER w AS old_value
        FROM e WINDOW w AS (PARTITION BY record_id ORDER BY seq))
      SELECT record_id, seq, modified,
        concat_ws(',', CASE WHEN event_type IS DISTINCT FROM old_type THEN 'event_type' END,
          CASE WHEN k IS DISTINCT FROM old_k THEN 'k' END,
          CASE WHEN value IS DISTINCT FROM old_value THEN 'value' END) AS changed_fields,
        CASE WHEN event_type IS DISTINCT FROM old_type THEN event_type END AS new_event_type,
        CASE WHEN k IS DISTINCT FROM old_k THEN k END AS new_k,
        CASE WHEN value IS DISTINCT FROM old_value THEN value END AS new_value
      FROM v WHERE old_seq IS NOT NULL AND (event_type, k, value) IS DISTINCT FROM (old_type, old_k, old_value)""",
    "fill_outcome_class": _ATTEMPTS + "SELECT record_id, seq, status, outcome FROM a",
    "retry_schedule": _retries(doubling=True),
    "retry_schedule_constant": _retries(doubling=False),
    "outage_windows": _ATTEMPTS + """, g AS (SELECT entity_type, run,
        min(ts) FILTER (outcome = 'transient') AS started, max(ts) FILTER (outcome = 'transient') AS last_failure,
        max(ts) FILTER (outcome <> 'transient') AS ended, count(*) FILTER (outcome = 'transient') AS n_failures
        FROM r GROUP BY entity_type, run)
      SELECT entity_type, started, last_failure, ended, n_failures,
        coalesce(ended, last_failure) - started > 600000 AS breached FROM g WHERE n_failures > 0""",
    "scalar_functions": f"""WITH {_INPUT}, y AS (SELECT *,
        CAST(least(60000, 1000 * pow(2, least(seq % 10, 6))) AS BIGINT) AS delay_ms FROM e)
      SELECT seq AS event_id, lower(type) = 'g' AS is_g, k AS k_strict,
        TRY_CAST(event_type AS BIGINT) AS not_a_number, k AS k_from_map, CAST(k AS VARCHAR) AS k_text,
        '/base/User/' || record_id AS path, upper(event_type) AS upper_type, delay_ms,
        greatest(0, delay_ms + ((seq % 1000003) * 7919) % (2 * CAST(floor(delay_ms * 0.2) AS BIGINT) + 1)
          - CAST(floor(delay_ms * 0.2) AS BIGINT)) AS jittered_ms,
        (ts // 1000) * 1000 AS from_seconds, ts AS from_millis, k > 50 AS breached,
        nullif(event_type, 'view') IS DISTINCT FROM 'click' AS differs,
        coalesce(nullif(value, 0.01), 0.0) AS value_or_zero FROM y""",
    "duplicate_fills": f"""WITH {_INPUT}, t AS (SELECT record_id, kind, ts, cutoff, seq * 2 AS seq FROM b
        UNION ALL SELECT record_id, kind, ts, cutoff, seq * 2 + 1 FROM b WHERE kind = 'F'),
      x AS (SELECT *,
        coalesce(last_value(CASE WHEN kind <> 'N' THEN kind END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'G', false) AS in_gap,
        first_value(CASE WHEN kind = 'F' THEN cutoff END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY seq
          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_cutoff FROM t)
      SELECT record_id, seq, CASE WHEN kind = 'G' AND in_gap THEN 'gap_dropped' WHEN kind = 'G' THEN 'command'
        WHEN kind = 'F' AND in_gap THEN 'filled' WHEN kind = 'F' THEN 'fill_ignored' WHEN NOT in_gap THEN 'forwarded'
        WHEN close_cutoff IS NULL THEN 'pending' WHEN ts > close_cutoff THEN 'flushed' ELSE 'dropped' END AS decision
      FROM x""",
    "replay_failed_gaps": _decided("f", strict=True) + """, o AS (SELECT *, max(CASE WHEN decision = 'command' THEN seq END) OVER (
        PARTITION BY record_id ORDER BY seq) AS open_seq FROM d),
      m AS (SELECT record_id, max(seq) FILTER (decision = 'fill_error' AND in_gap) AS failed_seq,
        arg_max(open_seq, seq) FILTER (decision = 'fill_error' AND in_gap) AS open_seq,
        max(seq) FILTER (decision = 'filled') AS mended_seq FROM o GROUP BY record_id)
      SELECT record_id, 'User' AS entity_type, CAST(open_seq AS VARCHAR) AS event_id, failed_seq FROM m
      WHERE failed_seq IS NOT NULL AND coalesce(mended_seq, -1) < failed_seq""",
    "gap_timeout": _limited(48 * 3600000, None) + _ROWS,
    "gap_timeout_stream": _limited(48 * 3600000, None) + """SELECT d.record_id, d.seq, CASE WHEN decision = 'pending'
      AND (SELECT max(ts) FROM b) > o.ts + 48 * 3600000 THEN 'dead_letter' ELSE decision END AS decision
      FROM d LEFT JOIN b o ON o.record_id = d.record_id AND o.seq = d.acted_seq""",
    "handover_stream": _decided() + _ROWS,
    "handover_stream_strict": _decided("f", strict=True) + _ROWS,
    "gap_stream_matched": _decided("f", strict=True) + _ROWS,
    "gap_overflow": _limited(None, 2) + _ROWS,
    "gap_limits": _LIMITS + _ROWS,
    "gap_limits_split": _LIMITS + _ROWS,
    "failed_gaps": _LIMITS + "SELECT record_id, open_seq, entity, event_id, " + _WHY + " AS failed FROM g",
    # A fill is late if a gap opened after the fill before it and has failed.
    "late_fill": _LIMITS + """, u AS (SELECT *, coalesce(max(CASE WHEN kind = 'F' THEN seq END) OVER (PARTITION BY record_id
        ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM d)
      SELECT record_id, seq, cutoff, decision FROM u WHERE decision = 'fill_ignored' AND EXISTS (
        SELECT 1 FROM g WHERE g.record_id = u.record_id AND g.open_seq > u.prev AND g.open_seq < u.seq)""",
    "reissued_commands": _LIMITS + """, m AS (SELECT record_id, max(seq) AS mended_seq FROM st WHERE act = 4 GROUP BY 1)
      , t AS (SELECT record_id, max(open_seq) AS open_seq, arg_max(why, open_seq) AS why FROM g GROUP BY 1)
      SELECT t.record_id, 'User' AS entity_type, CAST(t.open_seq AS VARCHAR) AS event_id, t.open_seq,
        """ + _WHY + """ AS failed
      FROM t LEFT JOIN m ON m.record_id = t.record_id WHERE coalesce(mended_seq, -1) < t.open_seq""",
    "dead_letters_replayed": _LIMITS + f""", {_IMAGES},
      o AS (SELECT rid, modified AS cut, name FROM i WHERE version = 1 AND modified IS NOT NULL),
      s AS (SELECT rid, modified AS cut, name FROM i WHERE version = 0),
      a AS (SELECT record_id, seq, acted_seq AS open_seq, ts, payload, CASE WHEN o.cut IS NULL THEN 2 ELSE 1 END AS run,
          coalesce(o.cut, s.cut) AS cutoff, coalesce(o.name, s.name) AS name
        FROM d LEFT JOIN o ON o.rid = record_id LEFT JOIN s ON s.rid = record_id
        WHERE decision = 'dead_letter' AND coalesce(o.cut, s.cut) IS NOT NULL)
      SELECT record_id, seq, open_seq, CASE WHEN ts > cutoff THEN 'flushed' ELSE 'dropped' END AS decision,
        CASE WHEN ts > cutoff THEN row_number() OVER (PARTITION BY record_id, ts > cutoff ORDER BY seq) END AS pos,
        CAST(seq AS VARCHAR) AS event_id, ts, payload, run FROM a
      UNION ALL SELECT record_id, NULL, arg_min(open_seq, seq), 'filled', 0, CAST(min(seq) AS VARCHAR), min(cutoff),
        '{{"name":"' || min(name) || '","lastModifiedEpochMs":' || min(cutoff) || '}}', min(run) FROM a GROUP BY record_id""",
    "gap_stream_equals_batch": _decided() + _ROWS,
    "gap_stream_limits": _LIMITS + _ROWS,
    "stream_pending": _decided() + "SELECT record_id, seq, ts, payload FROM d WHERE decision = 'pending'",
    "stream_outputs": _routed(strict=False, faulty=False),
    "stream_outputs_strict": _routed(strict=True, faulty=True),
    "stream_outputs_faulty": _routed(strict=False, faulty=True),
    "wire_decisions": _wire_decisions(strict=False),
    "wire_decisions_strict": _wire_decisions(strict=True),
    "wire_decisions_forced": _wire_decisions(strict=True, forced="k >= 50 AND k % 2 = 0"),
    "limited_output": _LIMITS + """, p AS (SELECT *, row_number() OVER (PARTITION BY record_id, end_seq, decision ORDER BY seq DESC) AS nth FROM d)
      SELECT record_id, CASE decision WHEN 'flushed' THEN end_seq ELSE seq END AS out_seq,
        CASE decision WHEN 'flushed' THEN nth ELSE 0 END AS out_pos, seq, coalesce(type, kind) AS type,
        CASE WHEN kind <> 'F' THEN CAST(seq AS VARCHAR) END AS event_id, CASE WHEN kind <> 'F' THEN ts END AS ts,
        CASE decision WHEN 'flushed' THEN end_at ELSE rec_ts END AS rec_ts, payload
      FROM p WHERE decision IN ('forwarded', 'filled', 'flushed')""",
    "limited_errors": _LIMITS + f"""SELECT record_id, seq, kind, decision, acted_seq AS cause_seq, CAST(NULL AS VARCHAR) AS message, payload
      FROM d WHERE decision = 'dead_letter'
      UNION ALL SELECT g.record_id, g.open_seq, 'G', 'gap_failed', NULL, {_WHY}, payload FROM g JOIN d ON d.record_id = g.record_id AND d.seq = g.open_seq""",
    "limited_counters": _LIMITS + f""", {_COUNTED.replace("'pending')", "'pending', 'dead_letter')")}
      SELECT received AS events_received, forwarded AS events_forwarded, dropped AS buffered_events_dropped,
      flushed AS buffered_events_flushed, buffered AS events_buffered, filled AS gap_events_filled, detected AS gap_event_detected,
      gap_dropped AS gap_event_dropped, command AS fill_commands_published, (SELECT count(*) FROM g) AS fill_commands_timeout,
      fills AS fill_event_received, CAST(0 AS BIGINT) AS invalid_events, CAST(0 AS BIGINT) AS invalid_fills FROM n""",
    "stream_newer_only": _decided("b", strict=True) + """, m AS (SELECT *, CASE WHEN decision = 'flushed' THEN close_seq ELSE seq END AS cause,
        CASE WHEN decision = 'flushed' THEN seq ELSE NULL END AS nth FROM d WHERE decision IN ('forwarded', 'filled', 'flushed')),
      n AS (SELECT *, max(ts) OVER (PARTITION BY record_id ORDER BY cause, nth NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM m)
      SELECT record_id, seq, decision, ts FROM n WHERE newest IS NULL OR ts > newest""",
    "stream_first_fills": f"""WITH {_INPUT} SELECT CAST(record_id AS VARCHAR) AS record_id, CAST(id AS VARCHAR) AS event_id, cutoff
      FROM b WHERE kind = 'F'""",
    "fill_command_source": _LOOKUP + f"SELECT CAST(record_id AS VARCHAR) AS key, {_FILL_EVENT} AS value, seq AS rec_offset FROM l",
    "second_worker": _LOOKUP + f"SELECT CAST(record_id AS VARCHAR) AS key, {_OLDER_EVENT} AS value, seq AS rec_offset FROM l WHERE is_success",
    # Each record with a gap stays open from its first G to the worker's answer, which comes last.
    "fill_loop": f"""WITH {_INPUT}, {_SNAPSHOT},
      o AS (SELECT record_id, min(seq) AS open_seq FROM e WHERE kind = 'G' GROUP BY record_id),
      y AS (SELECT o.*, coalesce(cut, -1) AS cut, CASE WHEN cut IS NULL THEN '{{}}'
        ELSE '{{"lastModifiedEpochMs":' || cut || ',"name":"' || name || '"}}' END AS img FROM o LEFT JOIN s ON record_id = rid),
      n AS (SELECT e.*, open_seq, cut FROM e LEFT JOIN y USING (record_id) WHERE kind = 'N'),
      z AS (SELECT 'CDC-OUTPUT' AS topic, record_id, {_CHANGE_JSON} AS value, seq AS cause, NULL AS nth FROM n
          WHERE open_seq IS NULL OR seq < open_seq
        UNION ALL SELECT 'CDC-OUTPUT', record_id, {_CHANGE_JSON}, 1000000000000, -seq FROM n WHERE seq > open_seq AND ts > cut
        UNION ALL SELECT 'CDC-FILL-COMMAND', record_id, {_COMMAND_JSON}, id, NULL FROM (SELECT record_id, open_seq AS id FROM y)
        UNION ALL SELECT 'CDC-OUTPUT', record_id, {_event_json("record_id", "'null'", "'null'", "'F'", "'0'", "img")}, 1000000000000, NULL FROM y)
      SELECT topic, CAST(record_id AS VARCHAR) AS key, value,
        row_number() OVER (PARTITION BY record_id ORDER BY cause, nth NULLS FIRST) AS rec_offset FROM z""",
}

# The streams that keep a table have to end up with the same table.
ORACLES |= {f"{name}_stream": ORACLES[name] for name in ("current_state", "materialized_image", "replay_gaps")}
ORACLES["outage_alarm_stream"] = _ATTEMPTS + """, g AS (SELECT entity_type, run,
    min(ts) FILTER (outcome = 'transient') AS started, max(ts) FILTER (outcome <> 'transient') AS ended FROM r GROUP BY entity_type, run)
  SELECT entity_type, started, started + 600001 AS breached_at FROM g
    WHERE coalesce(ended, (SELECT max(ts) FROM a)) - started > 600000"""
