"""The same mappings and operators as SQL, written independently of the Spark code.

Plain windows over whole keys are used here; the library splits those by slices.
"""

from __future__ import annotations

WINDOW = 86_400
THRESHOLD = 5


def fmt(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def uuid(fingerprint: str, source: str) -> str:
    h = f"sha1({fingerprint} || {source})"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12)"
    )


MODULE = "CASE WHEN value < 15 THEN 'auth' WHEN value < 60 THEN 'billing' ELSE 'search' END"

LINES = f"""e AS (
  SELECT event_id, ts, user_id, event_type, value, {MODULE} AS module,
         said, strftime(said, '%Y-%m-%dT%H:%M:%S') AS iso
  FROM (SELECT *, ts - CASE WHEN event_id % 97 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS said FROM events)),
numbered AS (
  SELECT *, 0 AS n, CASE event_type
    WHEN 'error' THEN strftime(said, '%Y-%m-%d %H:%M:%S,%g') || ' ERROR [' || module || '] request failed user=' || user_id
    WHEN 'purchase' THEN '{{"@timestamp":"' || strftime(said, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00","severity":"warning","msg":"payment slow","user":' || user_id || '}}'
    WHEN 'click' THEN '{{"ts":"' || iso || 'Z","msg":"INFO page served","user":' || user_id || '}}'
    WHEN 'view' THEN strftime(said + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00 WARN cache miss user=' || user_id
    ELSE 'user ' || user_id || ' signed up from 10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS line FROM e
  UNION ALL
  SELECT *, 1, CASE event_type
    WHEN 'error' THEN '    at app.' || module || '.Handler.run(Handler.java:' || (event_id % 90 + 10) || ')'
    WHEN 'view' THEN '   ' ELSE '' END FROM e WHERE event_type IN ('error', 'view', 'signup')
  UNION ALL
  SELECT *, 2, 'Caused by: java.lang.IllegalStateException: code ' || user_id FROM e WHERE event_type = 'error'),
lines AS (
  SELECT 'c-' || user_id AS source_id,
         CASE WHEN user_id % 2 = 0 THEN 'Customer#' || lpad(user_id::VARCHAR, 9, '0') END AS source_name,
         make_timestamp(epoch_us(ts) + 1000000 + n * (event_id % 4) * 300000) AS received_at,
         event_type = 'error' AS stderr, line, event_id * 10 + n AS seq FROM numbered)"""


def entries(max_lines: int = 500, idle_ms: int | None = 800) -> str:
    pause = (
        "FALSE"
        if idle_ms is None
        else f"coalesce(epoch_us(received_at) - epoch_us(lag(received_at) OVER w) >= {idle_ms * 1000}, FALSE)"
    )
    return f"""flagged AS (
  SELECT *, (line = '' OR NOT (regexp_full_match(line, '\\s*') OR starts_with(line, ' ') OR starts_with(line, chr(9))
         OR starts_with(line, 'at ') OR starts_with(line, 'Caused by:') OR starts_with(line, '...'))) OR {pause} AS opens
  FROM lines WINDOW w AS (PARTITION BY source_id ORDER BY seq)),
grouped AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp FROM flagged),
parted AS (
  SELECT *, (row_number() OVER (PARTITION BY source_id, grp ORDER BY seq) - 1) // {max_lines} AS part FROM grouped),
entries AS (
  SELECT source_id, arg_min(source_name, seq) AS source_name, arg_min(received_at, seq) AS seen, string_agg(line, chr(10) ORDER BY seq) AS message,
         count(*) AS line_count, min(seq) AS entry_seq
  FROM parted GROUP BY source_id, grp, part)"""


def normalised(column: str) -> str:
    x = column
    for pattern, placeholder in [
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
        (r"\b[a-fA-F0-9]{16,}\b", "<id>"),
        (r"\b\d+\b", "?"),
        (r"\s+", " "),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{placeholder}', 'g')"
    return f"trim({x})"


def token(column: str, name: str, edge: str) -> str:
    return f"regexp_matches({column}, '(?i)(^|{edge}){name}({edge}|$)')"


def level_case(column: str, edge: str, with_exception: bool) -> str:
    branches = [(name, level) for name, level in [
        ("ERROR", "ERROR"), ("WARN(ING)?", "WARN"), ("INFO", "INFO"), ("DEBUG", "DEBUG"), ("TRACE", "TRACE")]]
    if with_exception:
        branches.append(("EXCEPTION", "ERROR"))
    return "CASE " + " ".join(f"WHEN {token(column, n, edge)} THEN '{v}'" for n, v in branches) + " END"


_JSON_KEYED = "upper(trim(coalesce(json_extract_string(message, '$.level'), json_extract_string(message, '$.severity'), json_extract_string(message, '$.lvl'))))"
_JSON_TIME = "coalesce(json_extract_string(message, '$.\"@timestamp\"'), json_extract_string(message, '$.timestamp'), json_extract_string(message, '$.ts'), json_extract_string(message, '$.time'))"
_WORD = r"[^A-Za-z0-9_]"
_LETTER = r"[^\p{L}\p{Nd}]"

EVENTS = f"""routed AS (
  SELECT *, message LIKE '{{%}}' AND json_valid(message) AS is_json, trim(split_part(message, chr(10), 1)) AS first_line FROM entries),
fields AS (
  SELECT *,
    CASE WHEN is_json THEN {_JSON_TIME}
         ELSE replace(replace(nullif(regexp_extract(first_line, '\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}:\\d{{2}}([.,]\\d{{3}})?(Z|[+-]\\d{{2}}:?\\d{{2}})?'), ''), ',', '.'), ' ', 'T') END AS raw_time,
    CASE WHEN is_json THEN coalesce(
           CASE {_JSON_KEYED} WHEN 'WARNING' THEN 'WARN' WHEN 'ERROR' THEN 'ERROR' WHEN 'WARN' THEN 'WARN' WHEN 'INFO' THEN 'INFO' WHEN 'DEBUG' THEN 'DEBUG' WHEN 'TRACE' THEN 'TRACE' END,
           {level_case("json_extract_string(message, '$.msg')", _WORD, False)},
           {level_case("message", _WORD, False)}, 'UNKNOWN')
         ELSE coalesce({level_case("first_line", _LETTER, True)}, 'UNKNOWN') END AS level
  FROM routed),
log_events AS (
  SELECT source_id, source_name, seen AS ingest_time, is_json,
    TRY_CAST(regexp_replace(raw_time, '(Z|[+-]\\d{{2}}:\\d{{2}})$', '') AS TIMESTAMP)
      - to_hours(coalesce(TRY_CAST(nullif(regexp_extract(raw_time, '([+-]\\d{{2}}):\\d{{2}}$', 1), '') AS BIGINT), 0)) AS event_time,
    level, message, entry_seq AS seq, sha256({normalised("message")}) AS fingerprint
  FROM fields)"""

# The late rule, run by run: a run is a stretch of one fingerprint's events in one window.
COUNTED = f"""windowed AS (
  SELECT *, (epoch_us(coalesce(event_time, ingest_time)) // 1000000) // {WINDOW} * {WINDOW} AS window_second FROM log_events),
turned AS (
  SELECT *, CASE WHEN lag(window_second) OVER w IS NOT DISTINCT FROM window_second THEN 0 ELSE 1 END AS opens
  FROM windowed WINDOW w AS (PARTITION BY fingerprint ORDER BY seq)),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY fingerprint ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM turned),
sizes AS (SELECT fingerprint, run, any_value(window_second) AS w, count(*) AS n FROM runs GROUP BY fingerprint, run),
held AS (
  SELECT fingerprint, 0::HUGEINT AS run, 0::BIGINT AS base, []::STRUCT(w BIGINT, c BIGINT)[] AS kept FROM (SELECT DISTINCT fingerprint FROM sizes)
  UNION ALL
  SELECT fingerprint, run, base,
    CASE WHEN len(grown) > 3 THEN list_filter(grown, lambda x: x.w >= w - 2 * {WINDOW}) ELSE grown END
  FROM (
    SELECT s.fingerprint, s.run, s.w, coalesce(list_filter(h.kept, lambda x: x.w = s.w)[1].c, 0) AS base,
      list_append(list_filter(h.kept, lambda x: x.w <> s.w),
        {{'w': s.w, 'c': (coalesce(list_filter(h.kept, lambda x: x.w = s.w)[1].c, 0) + s.n)::BIGINT}}) AS grown
    FROM held h JOIN sizes s ON s.fingerprint = h.fingerprint AND s.run = h.run + 1)),
counted AS (
  SELECT r.*, h.base + row_number() OVER (PARTITION BY r.fingerprint, r.run ORDER BY seq) AS window_count
  FROM runs r JOIN held h ON h.fingerprint = r.fingerprint AND h.run = r.run)"""

ANOMALIES = f"""anomalies AS (
  SELECT fingerprint, level, source_id, source_name, ingest_time AS detected_at, window_count AS count, message AS sample_message, seq
  FROM counted WHERE level = 'ERROR' AND window_count > {THRESHOLD})"""

SUMMARISED = f"""summarised AS (
  SELECT a.*, CASE WHEN event_id % 3 <> 0 THEN 'Failure in ' || {MODULE} END AS s_title,
    CASE WHEN event_id % 3 <> 0 THEN 'Request failed & was <retried>, event ' || event_id END AS s_summary,
    CASE WHEN event_id % 3 <> 0 THEN 'Overload of ' || {MODULE} || chr(10) || 'after event ' || event_id END AS s_cause,
    CASE WHEN event_id % 3 <> 0 THEN 'Check ''limits''' END AS s_actions,
    CASE WHEN event_id % 3 <> 0 THEN CASE WHEN value < 30 THEN 'LOW' WHEN value < 60 THEN 'MEDIUM' ELSE 'HIGH' END END AS s_severity
  FROM anomalies a JOIN events ON event_id = seq // 10)"""

COMMANDS = f"""targets AS (
  SELECT event_id, ts, event_type, value, 'c-' || user_id AS own_source,
    sha256('?-?-? ?:?:?,? ERROR [' || {MODULE} || '] request failed user=? at app.' || {MODULE} ||
           '.Handler.run(Handler.java:?) Caused by: java.lang.IllegalStateException: code ?') AS own_fp
  FROM events WHERE event_type <> 'error'),
commands AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'missing-' || event_id
              WHEN event_type = 'purchase' AND value >= 20 AND value < 60 THEN 'no-such-' || event_id
              ELSE {uuid("own_fp", "own_source")} END AS incident_id,
    CASE WHEN NOT (event_type = 'view' AND value < 15) THEN own_fp END AS fingerprint,
    CASE WHEN NOT (event_type = 'view' AND value < 15) THEN own_source END AS source_id,
    CASE event_type WHEN 'signup' THEN 'ACKNOWLEDGED' WHEN 'view' THEN 'RESOLVED'
      WHEN 'click' THEN CASE WHEN value < 20 THEN 'CLOSED' ELSE 'SUPPRESSED' END
      ELSE CASE WHEN value < 20 THEN 'REGRESSED' WHEN value < 60 THEN 'RESOLVED' ELSE 'COUNT_INCREASED' END END AS type,
    CASE WHEN event_type = 'signup' THEN 'runtime' ELSE 'gui' END AS actor,
    CASE event_type WHEN 'click' THEN '  note ' || event_id || ' ' WHEN 'view' THEN '   ' END AS note,
    ts, event_id * 10 AS seq
  FROM targets),
incident_keys AS (
  SELECT DISTINCT fingerprint AS k_fp, source_id AS k_source, {uuid("fingerprint", "source_id")} AS k_id FROM anomalies),
looked_up AS (
  SELECT c.*, k_fp, k_source FROM commands c LEFT JOIN incident_keys ON incident_id = k_id),
resolved AS (
  SELECT incident_id, coalesce(k_fp, fingerprint) AS fingerprint, coalesce(k_source, source_id) AS source_id, type, actor, note, ts, seq
  FROM looked_up
  WHERE type IN ('ACKNOWLEDGED', 'SUPPRESSED', 'RESOLVED', 'REGRESSED', 'CLOSED')
    AND (k_fp IS NOT NULL OR (type = 'ACKNOWLEDGED' AND (fingerprint, source_id) IN (SELECT (k_fp, k_source) FROM incident_keys))))"""

FOLD = f"""firsts AS (SELECT fingerprint, source_id, min(seq) AS first_seq FROM anomalies GROUP BY ALL),
inputs AS (
  SELECT fingerprint, source_id, seq, 'ANOMALY' AS kind, detected_at AS ts, NULL::VARCHAR AS actor, NULL::VARCHAR AS note, count AS cnt, level, source_name,
         sample_message, s_title, s_summary, s_cause, s_actions, s_severity FROM summarised
  UNION ALL
  SELECT r.fingerprint, r.source_id, seq, type, ts, actor, nullif(trim(note), ''), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM resolved r JOIN firsts f ON r.fingerprint = f.fingerprint AND r.source_id = f.source_id AND r.seq > f.first_seq),
marked AS (
  SELECT *, kind = 'ANOMALY' AND coalesce(lag(kind) OVER w IN ('RESOLVED', 'CLOSED'), FALSE) AS regress,
    row_number() OVER w AS rn FROM inputs WINDOW w AS (PARTITION BY fingerprint, source_id ORDER BY seq)),
steps AS (
  SELECT *, sum((regress OR kind = 'REGRESSED')::INT) OVER w AS epoch,
    coalesce(last_value(CASE WHEN kind <> 'ANOMALY' THEN kind WHEN regress THEN 'REGRESSED' END IGNORE NULLS) OVER w, 'OPEN') AS status,
    last_value(cnt IGNORE NULLS) OVER w AS last_count, last_value(CASE WHEN kind = 'ANOMALY' THEN coalesce(source_name, chr(1)) END IGNORE NULLS) OVER w AS last_name,
    last_value(level IGNORE NULLS) OVER w AS last_level,
    last_value(sample_message IGNORE NULLS) OVER w AS last_sample,
    coalesce(last_value(s_title IGNORE NULLS) OVER w, 'Unknown incident') AS title,
    coalesce(last_value(s_summary IGNORE NULLS) OVER w, 'No summary available') AS summary,
    coalesce(last_value(s_cause IGNORE NULLS) OVER w, 'Unknown') AS cause,
    coalesce(last_value(s_actions IGNORE NULLS) OVER w, 'No suggested actions available') AS actions,
    coalesce(last_value(s_severity IGNORE NULLS) OVER w, 'UNKNOWN') AS severity
  FROM marked WINDOW w AS (PARTITION BY fingerprint, source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
last_epoch AS (
  SELECT fingerprint, source_id, epoch, coalesce(arg_max(ts, seq) FILTER (kind = 'RESOLVED'), arg_min(ts, seq) FILTER (kind = 'CLOSED')) AS resolved_at
  FROM steps GROUP BY ALL),
incidents AS (
  SELECT {uuid("s.fingerprint", "s.source_id")} AS id, s.fingerprint, s.source_id, nullif(arg_max(last_name, seq), chr(1)) AS source_name,
    arg_max(last_level, seq) AS log_level, arg_max(status, seq) AS status, arg_max(severity, seq) AS severity,
    arg_min(ts, seq) AS first_seen_at, arg_max(ts, seq) FILTER (kind = 'ANOMALY') AS last_seen_at,
    arg_min(ts, seq) FILTER (kind = 'ACKNOWLEDGED') AS acknowledged_at,
    arg_max(e.resolved_at, s.epoch) FILTER (e.epoch = s.last_e) AS resolved_at,
    sum(cnt)::BIGINT AS total_occurrences, arg_max(last_count, seq) AS last_window_count, arg_max(last_sample, seq) AS sample_message,
    arg_max(title, seq) AS ai_title, arg_max(summary, seq) AS ai_summary, arg_max(cause, seq) AS probable_cause,
    arg_max(actions, seq) AS suggested_actions, sum(regress::INT)::BIGINT AS regression_count
  FROM (SELECT *, max(epoch) OVER (PARTITION BY fingerprint, source_id) AS last_e FROM steps) s
  JOIN last_epoch e ON s.fingerprint = e.fingerprint AND s.source_id = e.source_id AND e.epoch = s.epoch
  GROUP BY s.fingerprint, s.source_id),
incident_events AS (
  SELECT {uuid("fingerprint", "source_id")} AS incident_id, CASE WHEN kind = 'ANOMALY' THEN 'CREATED' ELSE kind END AS type, ts AS created_at,
    fingerprint, source_id, nullif(last_name, chr(1)) AS source_name, last_count AS anomaly_count, severity, title, summary, cause AS probable_cause,
    actions AS suggested_actions, last_sample AS sample_message, actor, note, CASE WHEN kind <> 'ANOMALY' THEN kind END AS status, seq
  FROM steps WHERE rn = 1 OR kind <> 'ANOMALY')"""

SAMPLES = """samples AS (
  SELECT fingerprint, source_id, sample_message AS sample, min(seq) AS first_seq,
    row_number() OVER (PARTITION BY fingerprint, source_id ORDER BY min(seq), sample_message) AS position
  FROM anomalies WHERE trim(sample_message) <> '' GROUP BY fingerprint, source_id, sample_message)"""

CARDS = """recent AS (SELECT * FROM incidents ORDER BY last_seen_at DESC, id LIMIT 8),
cards AS (
  SELECT id, CASE WHEN length(first_sample) > 120 THEN substr(first_sample, 1, 117) || '...' ELSE first_sample END AS title,
    coalesce(source_name, source_id) AS source_name, source_id, severity, status, last_seen_at, all_samples AS summary,
    CASE severity WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END +
    CASE status WHEN 'REGRESSED' THEN 5 WHEN 'OPEN' THEN 4 WHEN 'ACKNOWLEDGED' THEN 3 WHEN 'SUPPRESSED' THEN 2 WHEN 'RESOLVED' THEN 1 ELSE 0 END AS priority_score
  FROM recent JOIN (SELECT fingerprint AS f, source_id AS s, arg_min(sample, position) AS first_sample, string_agg(sample, chr(10) ORDER BY position) AS all_samples
                    FROM samples GROUP BY ALL) ON fingerprint = f AND source_id = s)"""

SOURCES = """sources AS (
  SELECT lower(c_mktsegment) AS runtime_key, 'c-' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE c_name END AS name,
    CASE WHEN c_acctbal < 0 THEN 'unknown' WHEN c_acctbal < 5000 THEN 'Up ' || floor(c_acctbal)::BIGINT || ' minutes, health check pending' ELSE 'running' END AS status
  FROM customer)"""

JOBS = """jobs AS (
  SELECT o_orderkey AS id, lower(c_mktsegment) AS runtime_key, CASE WHEN count(*) > 1 THEN 'tail-all' ELSE 'tail-one' END AS command,
    string_agg('c-' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_linestatus = 'F') AS source_ids, o_orderdate AS started_at,
    CASE WHEN bool_and(l_linestatus = 'F') THEN 'stopped' ELSE 'running' END AS status, count(*) AS source_count
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY o_orderkey, c_mktsegment, o_orderdate),
owned AS (
  SELECT DISTINCT lower(c_mktsegment) AS runtime_key, 'c-' || l_partkey AS id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""

VIEWS = """views AS (
  SELECT s.*, o.id IS NOT NULL AS active FROM sources s LEFT JOIN owned o ON s.runtime_key = o.runtime_key AND s.id = o.id),
runtimes AS (
  SELECT runtime_key, count(*) AS running_sources, count(*) FILTER (active) AS active_sources,
         greatest(count(*) - count(*) FILTER (active), 0) AS idle_sources FROM views GROUP BY runtime_key)"""

_TO_ANOMALIES = [LINES, entries(), EVENTS, COUNTED, ANOMALIES]
_TO_FOLD = [*_TO_ANOMALIES, SUMMARISED, COMMANDS, FOLD]
_TO_CARDS = [*_TO_FOLD, SAMPLES, CARDS]
_DIMS = [SOURCES, JOBS, VIEWS]


def query(parts: list[str], select: str) -> str:
    recursive = "RECURSIVE " if COUNTED in parts else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + select


def to_events(select: str) -> str:
    return query([LINES, entries(), EVENTS], select)


def to_counted(select: str) -> str:
    return query([LINES, entries(), EVENTS, COUNTED], select)


def to_anomalies(select: str, *more: str) -> str:
    return query([*_TO_ANOMALIES, *more], select)


def to_fold(select: str) -> str:
    return query(_TO_FOLD, select)


def to_cards(select: str, *more: str) -> str:
    return query([*_TO_CARDS, *more], select)


def dims(select: str, *more: str) -> str:
    return query([*_DIMS, *more], select)


INCIDENT_COLUMNS = ", ".join(
    f"{fmt(name)} AS {name}" if name.endswith("_at") else name
    for name in (
        "id fingerprint source_id source_name log_level status severity first_seen_at last_seen_at acknowledged_at "
        "resolved_at total_occurrences last_window_count sample_message ai_title ai_summary probable_cause "
        "suggested_actions regression_count"
    ).split()
)
EVENT_COLUMNS = ", ".join(
    f"{fmt(name)} AS {name}" if name.endswith("_at") else name
    for name in (
        "incident_id type created_at fingerprint source_id source_name anomaly_count severity title summary "
        "probable_cause suggested_actions sample_message actor note status seq"
    ).split()
)
CARD_COLUMNS = f"id, title, source_name, source_id, severity, status, {fmt('last_seen_at')} AS last_seen_at, summary"
