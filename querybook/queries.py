"""Every registered query, by area. Each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text as text_functions
from emberline.functions.identity import fingerprint_of, incident_id, normalize_message
from emberline.operators import counting, dashboard, entries, incidents, notifications, parsing, summaries
from emberline.operators.dashboard import View
from emberline.plans.pipeline import Outcome, incidents_of, recent_cards
from emberline.session import shared_dir, stage
from emberline.sources import tables as stored
from emberline.sources.log_lines import in_arrival_order, kafka_log_lines, read_log_lines, read_source, store_by_source
from querybook import sql
from querybook import tables as given
from querybook.tables import SETTINGS, THRESHOLD, WINDOW, shown

Query = Callable[[SparkSession, str], DataFrame]
BOOK: dict[str, tuple[Query, str | None]] = {}


def registered(oracle: str | None = None, name: str | None = None):
    def add(function: Query) -> Query:
        BOOK[name or function.__name__] = (function, oracle)
        return function

    return add


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/emberline-{name}-{uuid.uuid4().hex}"


# --- lines and entries -----------------------------------------------------------------------

_LINE_COLUMNS = f"source_id, source_name, {sql.fmt('received_at')} AS received_at, stderr, line, seq"


@registered(sql.query([sql.LINES], f"SELECT 'DOCKER' AS source_type, {_LINE_COLUMNS} FROM lines"))
def log_lines(spark, d):
    return shown(given.log_lines(spark, d))


@registered(
    sql.query(
        [sql.LINES],
        f"SELECT source_id, 'logs' AS source_name, {sql.fmt('received_at')} AS received_at, line, seq FROM lines",
    )
)
def kafka_lines(spark, d):
    records = given.log_lines(spark, d).select(
        F.col("source_id").cast("binary").alias("key"),
        F.col("line").cast("binary").alias("value"),
        F.lit("logs").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("seq").alias("offset"),
        F.col("received_at").alias("timestamp"),
    )
    return shown(
        kafka_log_lines(records).select("source_id", "source_name", "received_at", "line", "seq")
    )


@registered(sql.query([sql.LINES], f"SELECT {_LINE_COLUMNS} FROM lines"))
def stored_lines(spark, d):
    """The lines written to the shared folder and read back through the reader of stored lines."""
    place = fresh_folder(spark, "lines")
    given.log_lines(spark, d).write.parquet(place)
    return shown(read_log_lines(spark, place).drop("source_type"))


@registered(
    sql.query(
        [sql.LINES],
        """SELECT source_id, line, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS source_seq,
        row_number() OVER (ORDER BY received_at, source_id, seq) AS position FROM lines""",
    )
)
def arrival_order(spark, d):
    """Lines numbered per source only, as topics and files do, in one order over all sources."""
    own = Window.partitionBy("source_id").orderBy("seq")
    lines = given.log_lines(spark, d).withColumn("seq", (F.row_number().over(own) - 1).cast("bigint"))
    ordered = in_arrival_order(lines)
    return dashboard.numbered(ordered, [F.col("seq")], "position").select("source_id", "line", "source_seq", "position")


@registered(sql.query([sql.LINES], "SELECT source_id, line, seq FROM lines WHERE source_id = 'c-7'"))
def select_source(spark, d):
    return dashboard.select_source(given.log_lines(spark, d), "c-7").select("source_id", "line", "seq")


@registered(sql.query([sql.LINES], "SELECT source_id, line, seq FROM lines WHERE source_id = 'c-7'"))
def select_stored_source(spark, d):
    """The same from lines stored by source, of which only one folder is read."""
    folder = fresh_folder(spark, "by-source")
    store_by_source(given.log_lines(spark, d), folder)
    return read_source(spark, folder, "c-7").select("source_id", "line", "seq")


_ENTRY_COLUMNS = f"SELECT source_id, source_name, {sql.fmt('seen')} AS seen, message, line_count, entry_seq FROM entries"


def _entries(lines: DataFrame, max_lines: int, idle_ms: int | None) -> DataFrame:
    return shown(entries.log_entries(lines, max_lines, idle_ms).drop("source_type"))


@registered(sql.query([sql.LINES, sql.entries(500, None)], _ENTRY_COLUMNS))
def multiline_entries(spark, d):
    return _entries(given.log_lines(spark, d), 500, None)


@registered(sql.query([sql.LINES, sql.entries(2, None)], _ENTRY_COLUMNS))
def multiline_max_lines(spark, d):
    return _entries(given.log_lines(spark, d), 2, None)


@registered(sql.query([sql.LINES, sql.entries(500, 800)], _ENTRY_COLUMNS))
def multiline_idle_split(spark, d):
    return _entries(given.log_lines(spark, d), 500, 800)


# --- parsing ---------------------------------------------------------------------------------


def _all_entries(spark, d) -> DataFrame:
    return entries.log_entries(given.log_lines(spark, d))


@registered(
    sql.to_events(
        "SELECT entry_seq, message LIKE '{%}' AS candidate, is_json FROM routed"
    )
)
def parse_route(spark, d):
    return _all_entries(spark, d).select(
        "entry_seq",
        parsing.is_json_candidate("message").alias("candidate"),
        parsing.json_fields("message").isNotNull().alias("is_json"),
    )


_PARSED = f"SELECT seq, {sql.fmt('event_time')} AS event_time, level FROM log_events"


@registered(sql.to_events(_PARSED + " WHERE is_json"))
def json_fields(spark, d):
    parsed = _all_entries(spark, d).select(
        F.col("entry_seq").alias("seq"), parsing.json_parser(F.col("message")).alias("parsed")
    )
    return shown(parsed.where(F.col("parsed").isNotNull()).select("seq", "parsed.*"))


@registered(sql.to_events(_PARSED.replace(" FROM", ", trim(split_part(message, chr(10), 1)) AS line FROM") + " WHERE NOT is_json"))
def text_fields(spark, d):
    texts = _all_entries(spark, d).where(parsing.json_fields("message").isNull())
    return shown(
        texts.select(
            F.col("entry_seq").alias("seq"),
            parsing.first_line("message").alias("line"),
            parsing.text_parser(F.col("message")).alias("parsed"),
        ).select("seq", "line", "parsed.*")
    )


@registered(
    sql.to_events(
        f"""SELECT 'DOCKER' AS source_type, source_id, source_name, {sql.fmt('ingest_time')} AS ingest_time,
        {sql.fmt('event_time')} AS event_time, level, message, fingerprint, 0::BIGINT AS attributes, seq FROM log_events"""
    )
)
def log_events(spark, d):
    events = given.log_events(spark, d)
    return shown(events.withColumn("attributes", F.size(F.map_keys("attributes"))))


@registered(
    sql.to_events(_PARSED)
)
def parse_with_parsers(spark, d):
    parsers = [parsing.json_parser, parsing.text_parser]
    return shown(parsing.parse_entries(_all_entries(spark, d), parsers).select("seq", "event_time", "level"))


# --- identity --------------------------------------------------------------------------------


@registered(f"SELECT doc_id, {sql.normalised('text')} AS normalized FROM documents")
def normalize(spark, d):
    return given.table(spark, d, "documents").select("doc_id", normalize_message("text").alias("normalized"))


@registered(f"SELECT doc_id, sha256({sql.normalised('text')}) AS fingerprint FROM documents")
def fingerprint(spark, d):
    return given.table(spark, d, "documents").select("doc_id", fingerprint_of("text").alias("fingerprint"))


@registered(
    f"""SELECT sha256({sql.normalised('line')}) AS fingerprint, count(*) AS lines
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL"""
)
def document_line_fingerprints(spark, d):
    lines = given.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(fingerprint_of("line").alias("fingerprint")).agg(F.count(F.lit(1)).alias("lines"))


@registered(
    f"""SELECT doc_id, {sql.uuid("sha256(" + sql.normalised("text") + ")", "source")} AS id FROM documents""",
    name="incident_id",
)
def incident_ids(spark, d):
    return given.table(spark, d, "documents").select(
        "doc_id", incident_id(fingerprint_of("text"), "source").alias("id")
    )


# --- counting --------------------------------------------------------------------------------


@registered(sql.to_counted("SELECT fingerprint, window_second, count(*) AS window_total FROM counted GROUP BY ALL"))
def window_counts(spark, d):
    return counting.window_counts(given.log_events(spark, d), WINDOW).select(
        "fingerprint", F.unix_seconds("window_start").alias("window_second"), "window_total"
    )


_COUNTED = "SELECT fingerprint, window_second, source_id, seq, level, window_count FROM counted"


def _counted_columns(counted: DataFrame) -> DataFrame:
    return counted.select(
        "fingerprint",
        F.unix_seconds("window_start").alias("window_second"),
        "source_id",
        "seq",
        "level",
        "window_count",
    )


@registered(sql.to_counted(_COUNTED))
def running_count(spark, d):
    return _counted_columns(counting.with_running_count(given.log_events(spark, d), WINDOW))


_ANOMALY_COLUMNS = f"SELECT fingerprint, level, source_id, source_name, {sql.fmt('detected_at')} AS detected_at, count, sample_message, seq FROM anomalies"


@registered(sql.to_anomalies(_ANOMALY_COLUMNS))
def anomalies(spark, d):
    return shown(given.anomalies(spark, d))


# --- incidents -------------------------------------------------------------------------------


@registered(
    sql.to_anomalies(
        f"""SELECT {sql.uuid("fingerprint", "source_id")} AS id, fingerprint, source_id, arg_max(source_name, seq) AS source_name,
        arg_max(level, seq) AS log_level, {sql.fmt("arg_min(detected_at, seq)")} AS first_seen_at,
        {sql.fmt("arg_max(detected_at, seq)")} AS last_seen_at, sum(count)::BIGINT AS total_occurrences,
        arg_max(count, seq) AS last_window_count FROM anomalies GROUP BY fingerprint, source_id"""
    )
)
def incident_rollup(spark, d):
    return shown(incidents.rollup_incidents(given.anomalies(spark, d)))


@registered(
    sql.to_anomalies("SELECT fingerprint, source_id, sample, first_seq, position FROM samples", sql.SAMPLES)
)
def incident_samples(spark, d):
    return incidents.incident_samples(given.anomalies(spark, d))


def _outcome(spark, d) -> Outcome:
    return incidents_of(given.summarised_anomalies(spark, d), given.commands(spark, d))


@registered(sql.to_fold(f"SELECT {sql.INCIDENT_COLUMNS} FROM incidents"))
def incident_fold(spark, d):
    return shown(_outcome(spark, d).fold.incidents.drop("tags"))


@registered(sql.to_fold(f"SELECT {sql.INCIDENT_COLUMNS} FROM incidents"))
def incident_merge(spark, d):
    """The same incidents in two runs: the first half is stored, the second continues from it."""
    found = given.summarised_anomalies(spark, d)
    orders = given.commands(spark, d)
    cut = given.table(spark, d, "events").agg(F.expr("10 * (max(event_id) div 2)")).first()[0]
    early = F.col("seq") < cut
    first = incidents_of(found.where(early), orders.where(early))
    table = stored.incident_table(fresh_folder(spark, "incidents"))
    table.write(first.fold.incidents, 0, list(range(table.buckets)))
    second = incidents_of(found.where(~early), orders.where(~early), table.read(spark, 0))
    return shown(second.fold.incidents.drop("tags"))


@registered(
    sql.to_anomalies("SELECT fingerprint, source_id, sample, first_seq, position FROM samples", sql.SAMPLES)
)
def incident_merge_samples(spark, d):
    """The samples of two runs, the second of which adds what the first has not stored."""
    found = given.anomalies(spark, d)
    cut = given.table(spark, d, "events").agg(F.expr("10 * (max(event_id) div 2)")).first()[0]
    folder = fresh_folder(spark, "samples")
    for batch, part in enumerate([F.col("seq") < cut, F.col("seq") >= cut]):
        known = stored.read_samples(spark, folder, batch)
        stored.append_samples(incidents.new_samples(found.where(part), known), folder, batch)
    return incidents.numbered_samples(stored.read_samples(spark, folder))


@registered(sql.to_fold(f"SELECT {sql.EVENT_COLUMNS} FROM incident_events"))
def incident_events(spark, d):
    return shown(_outcome(spark, d).fold.events.drop("id"))


@registered(sql.to_fold(f"SELECT {sql.EVENT_COLUMNS} FROM incident_events"))
def incident_events_append(spark, d):
    """Events written by two batches, one of them retried, and read back."""
    folder = fresh_folder(spark, "events")
    events = _outcome(spark, d).fold.events
    created = events.where(F.col("type") == "CREATED")
    stored.append_incident_events(created, folder, 0)
    stored.append_incident_events(events.where(F.col("type") != "CREATED"), folder, 1)
    stored.append_incident_events(created, folder, 0)
    return shown(stored.read_incident_events(spark, folder).drop("id", "batch_id"))


@registered(
    sql.to_fold(
        f"SELECT {sql.EVENT_COLUMNS} FROM incident_events QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, seq DESC) = 1"
    )
)
def latest_event(spark, d):
    return shown(incidents.latest_events(_outcome(spark, d).fold.events).drop("id"))


@registered(
    sql.to_fold(f"SELECT {sql.EVENT_COLUMNS} FROM incident_events WHERE incident_id = (SELECT max(id) FROM incidents)")
)
def events_of_incident(spark, d):
    events = _outcome(spark, d).fold.events
    chosen = events.agg(F.max("incident_id")).first()[0]
    return shown(incidents.find_events(events, chosen or "").drop("id"))


@registered(
    sql.to_fold(f"SELECT {sql.EVENT_COLUMNS} FROM incident_events WHERE incident_id = (SELECT max(id) FROM incidents)")
)
def stored_events_of_incident(spark, d):
    """The same from an event table written in portions that were merged on the way; one bucket is read."""
    log = stored.EventLog(fresh_folder(spark, "event-log"), merge=2)
    events = stage(_outcome(spark, d).fold.events, "events")
    chosen, last = events.agg(F.max("incident_id"), F.max("seq")).first()
    part = F.expr(f"seq * 5 div {(last or 0) + 1}")
    for batch in range(5):
        log.append(events.where(part == batch), batch)
    return shown(log.of_incident(spark, chosen or "").drop("id", "batch_id"))


_HISTORY = f"SELECT i.id AS incident_id, i.status AS incident_status, e.type, {sql.fmt('e.created_at')} AS created_at, e.seq FROM incidents i JOIN incident_events e ON i.id = e.incident_id"


@registered(sql.to_fold(_HISTORY))
def event_history(spark, d):
    fold = _outcome(spark, d).fold
    return shown(
        incidents.event_history(fold.incidents, fold.events).select(
            "incident_id", "incident_status", "type", "created_at", "seq"
        )
    )


@registered(sql.to_fold(_HISTORY + " WHERE e.type = 'RESOLVED'"))
def event_history_by_type(spark, d):
    fold = _outcome(spark, d).fold
    return shown(
        incidents.event_history(fold.incidents, fold.events, "RESOLVED").select(
            "incident_id", "incident_status", "type", "created_at", "seq"
        )
    )


@registered(
    sql.to_fold("SELECT incident_id, fingerprint, source_id, type, seq FROM resolved")
)
def resolved_commands(spark, d):
    known = incidents.rollup_incidents(given.anomalies(spark, d))
    resolved = incidents.resolve_commands(given.commands(spark, d), known).resolved
    return resolved.select("incident_id", "fingerprint", "source_id", "type", "seq")


@registered(
    sql.to_fold(
        """SELECT incident_id, fingerprint, source_id, type, seq, 'unsupported event type' AS reason FROM commands WHERE type = 'COUNT_INCREASED'
        UNION ALL
        SELECT incident_id, l.fingerprint, l.source_id, type, seq, 'incident not found' FROM looked_up l
        WHERE type <> 'COUNT_INCREASED' AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.seq = l.seq AND s.kind <> 'ANOMALY')"""
    )
)
def rejected_commands(spark, d):
    """All ineffective commands, under the identity they were given with."""
    rejected = _outcome(spark, d).rejected.select("seq", "reason")
    return (
        given.commands(spark, d)
        .select("incident_id", "fingerprint", "source_id", "type", "seq")
        .join(rejected, "seq")
    )


@registered(
    sql.to_fold(
        f"""SELECT a.seq, a.fingerprint, a.source_id, i.id AS incident_id, i.status AS incident_status
        FROM anomalies a LEFT JOIN incidents i ON a.fingerprint = i.fingerprint AND a.source_id = i.source_id"""
    )
)
def attach_incident(spark, d):
    found = given.anomalies(spark, d)
    folded = incidents_of(given.summarised(spark, d, found), given.commands(spark, d)).fold.incidents
    attached = incidents.attach_incident(found, folded)
    return attached.select("seq", "fingerprint", "source_id", "incident_id", "incident_status")


# --- summaries, prompts, notifications -------------------------------------------------------

_ANSWER = """answered AS (
  SELECT fingerprint, source_id, seq, CASE (seq // 10) % 4 WHEN 3 THEN 'AI Incident Analysis Failed' ELSE 'AI Incident Analysis' END AS title,
    CASE (seq // 10) % 4 WHEN 1 THEN 'No response content returned by model' WHEN 2 THEN 'Answer for ' || (seq // 10) ELSE 'The AI model call failed' END AS summary,
    CASE (seq // 10) % 4 WHEN 1 THEN 'Unknown' WHEN 2 THEN 'See AI analysis' ELSE 'TimeoutException' END AS probable_cause,
    CASE (seq // 10) % 4 WHEN 1 THEN 'Check model configuration and API response' WHEN 2 THEN 'See AI analysis'
      ELSE 'Check API key, model name, network connectivity, and Spring AI configuration' END AS suggested_actions,
    'UNKNOWN' AS severity FROM anomalies WHERE (seq // 10) % 4 <> 0)"""


@registered(sql.to_anomalies("SELECT * FROM answered", _ANSWER))
def map_summary(spark, d):
    answers = given.responses(spark, d, given.anomalies(spark, d))
    return answers.select(
        "fingerprint",
        "source_id",
        "seq",
        summaries.map_summary("response", "error").alias("summary"),
    ).select("fingerprint", "source_id", "seq", "summary.*")


@registered(
    sql.to_anomalies(
        """SELECT a.seq, a.fingerprint, a.source_id, coalesce(w.title, 'Unknown incident') AS title, coalesce(w.summary, 'No summary available') AS summary,
        coalesce(w.probable_cause, 'Unknown') AS probable_cause, coalesce(w.suggested_actions, 'No suggested actions available') AS suggested_actions,
        coalesce(w.severity, 'UNKNOWN') AS severity FROM anomalies a LEFT JOIN answered w ON a.seq = w.seq""",
        _ANSWER,
    )
)
def resolve_summary(spark, d):
    found = given.anomalies(spark, d)
    answered = summaries.with_summaries(found, given.responses(spark, d, found))
    nothing = F.lit(None).cast(answered.schema["summary"].dataType)
    return answered.select(
        "seq", "fingerprint", "source_id", summaries.resolve_summary("summary", nothing).alias("_s")
    ).select("seq", "fingerprint", "source_id", "_s.*")


@registered(
    sql.to_anomalies(
        "SELECT fingerprint, level, count, source_id, source_name, sample_message AS sample_messages, seq FROM anomalies"
    )
)
def summary_requests(spark, d):
    return shown(summaries.summary_requests(given.anomalies(spark, d)))


_PROMPT = (
    "'You are analyzing an application incident detected from logs.\n\nFingerprint: ' || fingerprint || '\nLevel: ' || level || "
    "'\nOccurrences in current window: ' || count || '\nSource ID: ' || source_id || '\nSource Name: ' || coalesce(source_name, 'unknown') || "
    "'\n\nSample logs:\n1. ' || sample_message || '\n\n\nProvide:\n1. A short title\n2. A short summary of what likely happened\n"
    "3. The probable root cause\n4. Suggested investigation steps\n5. Severity (LOW, MEDIUM, HIGH)\n\nFormat the response as plain text.\n'"
)


@registered(sql.to_anomalies(f"SELECT seq, {_PROMPT} AS prompt FROM anomalies"))
def prompts(spark, d):
    requests = summaries.summary_requests(given.anomalies(spark, d))
    return requests.select("seq", summaries.render_prompt().alias("prompt"))


_ISO = "strftime(detected_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(detected_at) % 1000000 = 0 THEN '' ELSE rtrim(strftime(detected_at, '.%f'), '0') END || 'Z'"
_MAIL = f"""mail AS (
  SELECT *, coalesce(s_title, 'Unknown incident') AS title, coalesce(s_summary, 'No summary available') AS summary,
    coalesce(s_cause, 'Unknown') AS cause, coalesce(s_actions, 'No suggested actions available') AS actions, coalesce(s_severity, 'UNKNOWN') AS severity,
    coalesce(source_name, 'unknown') AS name, {_ISO} AS seen_at FROM summarised)"""


def _escaped(column: str) -> str:
    for plain, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")]:
        column = f"replace({column}, '{plain}', '{entity}')"
    return column


def _paragraphs(column: str) -> str:
    return f"replace({_escaped(column)}, chr(10), '<br/>')"


_SUBJECT = "'[Watch] [' || severity || '] ' || level || ' anomaly in ' || name"
_TEXT = (
    "'Incident Watch detected an anomaly and generated the following incident summary.\n\nIncident overview\n- Title: ' || title || "
    "'\n- Severity: ' || severity || '\n- Log level: ' || level || '\n- Occurrences in the current window: ' || count || "
    "'\n- Detected at (UTC): ' || seen_at || '\n- Source name: ' || name || '\n- Source id: ' || source_id || '\n- Fingerprint: ' || fingerprint || "
    "'\n\nWhat happened\n' || summary || '\n\nProbable cause\n' || cause || '\n\nRecommended investigation steps\n' || actions || "
    "'\n\nSample log\n' || trim(sample_message) || '\n\nThis email was generated automatically by Incident Watch.\n'"
)
_HTML = (
    "'<html><body><header><small>Incident Watch Incident Notification</small><h1>' || " + _escaped("title")
    + " || '</h1><p>Source: <strong>' || name || '</strong></p></header><dl>"
    "<dt>Severity</dt><dd>' || severity || '</dd><dt>Log Level</dt><dd>' || level || '</dd><dt>Occurrences</dt><dd>' || count || ' in current window</dd>"
    "<dt>Detected At</dt><dd>' || seen_at || '</dd><dt>Source</dt><dd>' || name || ' (' || source_id || ')</dd><dt>Fingerprint</dt><dd>' || fingerprint || '</dd></dl>"
    "<h2>What Happened</h2><p>' || " + _paragraphs("summary") + " || '</p><h2>Probable Cause</h2><p>' || " + _paragraphs("cause")
    + " || '</p><h2>Recommended Investigation Steps</h2><p>' || " + _paragraphs("actions") + " || '</p><h2>Sample Log</h2><pre>' || "
    + _escaped("trim(sample_message)") + " || '</pre></body></html>\n'"
)


@registered(
    sql.to_anomalies(
        f"SELECT 'a@x.org|b@x.org' AS recipients, 'w@x.org' AS sender, NULL::VARCHAR AS reply_to, {_SUBJECT} AS subject, {_TEXT} AS text_body, {_HTML} AS html_body, fingerprint, source_id, seq FROM mail",
        sql.SUMMARISED,
        _MAIL,
    )
)
def notifications_table(spark, d):
    settings = notifications.NotificationSettings(
        to="a@x.org, ,b@x.org,", sender=" w@x.org ", subject_prefix=" [Watch] "
    )
    found = given.summarised_anomalies(spark, d)
    nothing = F.lit(None).cast(found.schema["summary"].dataType)
    resolved = found.withColumn("summary", summaries.resolve_summary("summary", nothing))
    return shown(notifications.build_notifications(resolved, settings))


@registered(f"SELECT doc_id, {_escaped('text')} AS escaped, {_paragraphs('trim(text, chr(32) || chr(9) || chr(10) || chr(13))')} AS paragraphs FROM documents")
def escape_html(spark, d):
    return given.table(spark, d, "documents").select(
        "doc_id",
        text_functions.escape_html("text").alias("escaped"),
        text_functions.html_paragraphs("text").alias("paragraphs"),
    )


@registered(
    """SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS title,
    CASE WHEN length(source) > 4 THEN substr(source, 1, 1) || '...' ELSE source END AS short_source,
    regexp_replace(lower(trim(source)), '[^a-z0-9]+', '-', 'g') AS badge FROM documents"""
)
def abbreviations(spark, d):
    return given.table(spark, d, "documents").select(
        "doc_id",
        text_functions.abbreviate("text", 120).alias("title"),
        text_functions.shorten("source", 4).alias("short_source"),
        text_functions.badge_slug("source").alias("badge"),
    )


@registered(
    sql.to_fold("SELECT seq, nullif(trim(note), '') AS note, lower(trim('  ' || actor)) AS actor_key FROM commands")
)
def operator_notes(spark, d):
    return given.commands(spark, d).select(
        "seq",
        text_functions.trim_to_null("note").alias("note"),
        text_functions.runtime_key(F.concat(F.lit("  "), "actor")).alias("actor_key"),
    )


# --- sources, runtimes and jobs --------------------------------------------------------------


@registered(sql.query([sql.SOURCES], "SELECT * FROM sources"))
def list_sources(spark, d):
    return given.sources(spark, d)


@registered(
    sql.query(
        [sql.SOURCES],
        """SELECT id AS source_id, CASE WHEN length(name) > 30 THEN substr(name, 1, 27) || '...' ELSE name END AS name,
        CASE WHEN length(status) > 25 THEN substr(status, 1, 22) || '...' ELSE status END AS status FROM sources""",
    )
)
def source_listing(spark, d):
    return dashboard.source_listing(given.sources(spark, d))


@registered(sql.dims("SELECT runtime_key, id, name, status FROM views WHERE NOT active"))
def available_sources(spark, d):
    return dashboard.select_available_sources(given.sources(spark, d), given.jobs(spark, d))


def _views(spark, d) -> DataFrame:
    return stage(dashboard.source_views(given.sources(spark, d), given.jobs(spark, d)), "views")


@registered(sql.dims("SELECT * FROM views"))
def source_views(spark, d):
    return _views(spark, d)


@registered(sql.dims("SELECT * FROM runtimes"))
def runtime_summary(spark, d):
    return dashboard.runtime_summary(_views(spark, d))


_PAGE = "page AS (SELECT *, row_number() OVER (PARTITION BY runtime_key ORDER BY id) AS position FROM views QUALIFY position <= 20)"


@registered(sql.dims("SELECT * FROM page", _PAGE))
def page_sources(spark, d):
    return dashboard.page_sources(_views(spark, d))


@registered(
    sql.dims(
        """SELECT r.*, s.sources FROM runtimes r JOIN (SELECT runtime_key, string_agg(id || ':' || active, '|' ORDER BY position) AS sources
        FROM page GROUP BY runtime_key) s ON r.runtime_key = s.runtime_key""",
        _PAGE,
    )
)
def runtime_panels(spark, d):
    panels = dashboard.runtime_panels(_views(spark, d))
    names = F.transform("sources", lambda item: F.concat(item["id"], F.lit(":"), item["active"].cast("string")))
    return shown(panels.withColumn("sources", names))


_JOB_COLUMNS = f"SELECT id, runtime_key, command, source_ids, {sql.fmt('started_at')} AS started_at, status, source_count FROM jobs"


@registered(sql.dims(_JOB_COLUMNS))
def job_views(spark, d):
    return shown(dashboard.job_views(given.jobs(spark, d)))


@registered(sql.dims(_JOB_COLUMNS + " WHERE status = 'running'"))
def list_jobs(spark, d):
    return shown(dashboard.list_jobs(given.jobs(spark, d)))


@registered(
    sql.dims(
        _JOB_COLUMNS
        + " WHERE status = 'running' AND runtime_key = 'building' AND (contains(command, 'c-12') OR len(list_filter(string_split(source_ids, '|'), lambda x: contains(x, 'c-12'))) > 0)"
    )
)
def filter_jobs(spark, d):
    return shown(dashboard.filter_jobs(given.jobs(spark, d), View(search="C-12", runtime="building")))


_MATCH = "(contains(runtime_key, '{s}') OR contains(lower(id), '{s}') OR contains(lower(name), '{s}') OR contains(lower(status), '{s}') OR contains(CASE WHEN active THEN 'tailing' ELSE 'idle' END, '{s}'))"


@registered(sql.dims("SELECT * FROM views WHERE runtime_key = 'machinery' AND " + _MATCH.format(s="pending")))
def filter_sources(spark, d):
    return dashboard.filter_sources(_views(spark, d), View(search="Pending", runtime="machinery"))


_RUNTIMES_FOUND = (
    "found AS (SELECT r.*, (SELECT count(*) FROM views v WHERE v.runtime_key = r.runtime_key AND "
    + _MATCH.replace("runtime_key", "v.runtime_key").format(s="uil")
    + ") AS listed_sources FROM runtimes r), kept AS (SELECT * FROM found WHERE contains(runtime_key, 'uil') OR listed_sources > 0)"
)


@registered(sql.dims("SELECT * FROM kept", _RUNTIMES_FOUND))
def filter_runtimes(spark, d):
    views = _views(spark, d)
    return dashboard.filter_runtimes(dashboard.runtime_summary(views), views, View(search="uil"))


@registered(
    sql.dims(
        """SELECT 'all' AS key, (SELECT count(*) FROM kept) AS count
        UNION ALL SELECT runtime_key, active_sources FROM runtimes""",
        _RUNTIMES_FOUND,
    )
)
def runtime_filter_counts(spark, d):
    views = _views(spark, d)
    runtimes = dashboard.runtime_summary(views)
    return dashboard.runtime_filter_counts(
        runtimes, dashboard.filter_runtimes(runtimes, views, View(search="uil"))
    )


# --- incident dashboard ----------------------------------------------------------------------


def _cards(spark, d) -> DataFrame:
    found = given.summarised_anomalies(spark, d)
    folded = incidents_of(found, given.commands(spark, d)).fold.incidents
    return stage(recent_cards(stage(folded, "incidents"), found), "cards")


@registered(sql.to_cards(f"SELECT {sql.INCIDENT_COLUMNS} FROM recent"))
def recent_incidents(spark, d):
    return shown(dashboard.recent_incidents(_outcome(spark, d).fold.incidents).drop("tags"))


@registered(sql.to_cards(f"SELECT {sql.INCIDENT_COLUMNS} FROM recent WHERE FALSE"))
def recent_incidents_none(spark, d):
    """A negative limit shows nothing."""
    return shown(dashboard.recent_incidents(_outcome(spark, d).fold.incidents, -3).drop("tags"))


@registered(
    sql.to_cards(
        f"SELECT {sql.CARD_COLUMNS}, 'ACKNOWLEDGED|SUPPRESSED|RESOLVED|REGRESSED|CLOSED' AS available_event_types FROM cards"
    )
)
def incident_cards(spark, d):
    return shown(_cards(spark, d))


_RANKED = f"SELECT {sql.CARD_COLUMNS}, priority_score, row_number() OVER (ORDER BY priority_score DESC, cards.last_seen_at DESC, id) AS position FROM cards"


@registered(sql.to_cards(_RANKED))
def ranked_incidents(spark, d):
    return shown(dashboard.rank_incidents(_cards(spark, d)).drop("available_event_types"))


_ALL_CARDS = """all_cards AS (
  SELECT id, CASE WHEN length(first_sample) > 120 THEN substr(first_sample, 1, 117) || '...' ELSE first_sample END AS title,
    coalesce(source_name, source_id) AS source_name, source_id, severity, status, last_seen_at, all_samples AS summary
  FROM incidents JOIN (SELECT fingerprint AS f, source_id AS s, arg_min(sample, position) AS first_sample, string_agg(sample, chr(10) ORDER BY position) AS all_samples
                       FROM samples GROUP BY ALL) ON fingerprint = f AND source_id = s)"""


def _search(spark, d, view: View) -> DataFrame:
    found = given.summarised_anomalies(spark, d)
    folded = stage(incidents_of(found, given.commands(spark, d)).fold.incidents, "incidents")
    samples = stage(incidents.incident_samples(found), "samples")
    cards = dashboard.find_incidents(folded, samples, view, given.sources(spark, d))
    return shown(cards.drop("available_event_types"))


def _found(condition: str) -> str:
    return sql.to_cards(f"SELECT {sql.CARD_COLUMNS} FROM all_cards WHERE {condition}", _ALL_CARDS, sql.SOURCES)


def _holds(text: str) -> str:
    fields = ["title", "summary", "source_name", "source_id", "status", "severity"]
    return "(" + " OR ".join(f"contains(lower({name}), '{text}')" for name in fields) + ")"


@registered(_found("severity = 'HIGH' AND status = 'SUPPRESSED' AND " + _holds("search")))
def filter_incidents(spark, d):
    return _search(spark, d, View(search="SEARCH", severity="HIGH", status="SUPPRESSED"))


@registered(_found("severity = 'LOW'"))
def filter_incidents_by_severity(spark, d):
    return _search(spark, d, View(severity="LOW"))


@registered(_found("status = 'REGRESSED'"))
def filter_incidents_by_status(spark, d):
    return _search(spark, d, View(status="REGRESSED"))


@registered(_found(_holds("code 1")))
def filter_incidents_by_sample(spark, d):
    """A text that stands in the last line of samples, whichever sample of the incident it is."""
    return _search(spark, d, View(search="Code 1"))


@registered(_found(_holds("customer#000000012")))
def filter_incidents_by_source(spark, d):
    return _search(spark, d, View(search="customer#000000012"))


_IN_BUILDING = """(source_id IN (SELECT id FROM sources WHERE runtime_key = 'building')
  OR source_name IN (SELECT name FROM sources WHERE runtime_key = 'building'))"""


@registered(_found(_IN_BUILDING))
def incidents_in_runtime(spark, d):
    return _search(spark, d, View(runtime="building"))


@registered(sql.to_cards("SELECT id, position, sample FROM incidents JOIN samples USING (fingerprint, source_id)"))
def samples_of_incidents(spark, d):
    found = given.summarised_anomalies(spark, d)
    folded = incidents_of(found, given.commands(spark, d)).fold.incidents
    return dashboard.samples_of(folded, incidents.incident_samples(found))


@registered(
    sql.to_cards(
        f"SELECT {sql.CARD_COLUMNS}, score AS priority_score, row_number() OVER (ORDER BY score DESC, last_seen_at DESC, id) AS position FROM scored",
        _ALL_CARDS,
        """scored AS (SELECT *, CASE severity WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END +
          CASE status WHEN 'REGRESSED' THEN 5 WHEN 'OPEN' THEN 4 WHEN 'ACKNOWLEDGED' THEN 3 WHEN 'SUPPRESSED' THEN 2 WHEN 'RESOLVED' THEN 1 ELSE 0 END AS score FROM all_cards)""",
    )
)
def ranked_search(spark, d):
    """Every incident ranked, not only those of one page."""
    found = given.summarised_anomalies(spark, d)
    folded = stage(incidents_of(found, given.commands(spark, d)).fold.incidents, "incidents")
    cards = dashboard.find_incidents(folded, stage(incidents.incident_samples(found), "samples"), View())
    return shown(dashboard.rank_incidents(cards).drop("available_event_types"))


_CLOSED = f"""overlaid AS (
  SELECT id, 'Reviewed' AS title, source_name, source_id, severity, 'CLOSED' AS status, last_seen_at, summary FROM cards WHERE severity = 'LOW'
  UNION ALL SELECT id, title, source_name, source_id, severity, status, last_seen_at, summary FROM cards WHERE severity <> 'LOW')"""


def _overlaid(spark, d) -> DataFrame:
    cards = _cards(spark, d).drop("available_event_types")
    updated = (
        cards.where(F.col("severity") == "LOW")
        .withColumn("title", F.lit("Reviewed"))
        .withColumn("status", F.lit("CLOSED"))
    )
    return dashboard.overlay_incidents(cards, updated)


@registered(sql.to_cards(f"SELECT {sql.CARD_COLUMNS} FROM overlaid", _CLOSED))
def overlay_incidents(spark, d):
    return shown(_overlaid(spark, d))


@registered(
    sql.to_cards(
        "SELECT count(*) FILTER (status = 'OPEN') AS open_incidents, count(*) AS visible_incidents FROM overlaid", _CLOSED
    )
)
def overlay_metrics(spark, d):
    """Open and visible incidents counted again after the overlay."""
    return dashboard.card_metrics(_overlaid(spark, d))


_METRICS = """metrics AS (
  SELECT (SELECT count(*) FROM runtimes) AS connected_runtimes, (SELECT count(*) FROM jobs WHERE status = 'running') AS active_jobs,
    (SELECT count(*) FROM cards WHERE status = 'OPEN') AS open_incidents, (SELECT count(*) FROM cards) AS visible_incidents)"""


@registered(sql.to_cards("SELECT * FROM metrics", *sql._DIMS, _METRICS))
def overview_metrics(spark, d):
    return dashboard.overview_metrics(
        dashboard.runtime_summary(_views(spark, d)), given.jobs(spark, d), _cards(spark, d)
    )


_SHOWN = """shown AS (SELECT * FROM cards WHERE contains(lower(title || chr(1) || summary || chr(1) || source_name || chr(1) || source_id || chr(1) || status || chr(1) || severity), 'uil')),
shown_jobs AS (SELECT * FROM jobs WHERE status = 'running' AND contains(runtime_key, 'uil'))"""


@registered(
    sql.to_cards(
        """SELECT 'connected_runtimes' AS key, connected_runtimes AS value, (SELECT count(*) FROM kept) AS shown, TRUE AS filtered FROM metrics
        UNION ALL SELECT 'active_jobs', active_jobs, (SELECT count(*) FROM shown_jobs), TRUE FROM metrics
        UNION ALL SELECT 'open_incidents', open_incidents, (SELECT count(*) FROM shown WHERE status = 'OPEN'), TRUE FROM metrics
        UNION ALL SELECT 'visible_incidents', (SELECT count(*) FROM shown), (SELECT count(*) FROM shown), TRUE""",
        *sql._DIMS,
        _METRICS,
        _RUNTIMES_FOUND,
        _SHOWN,
    )
)
def filtered_metrics(spark, d):
    view = View(search="uil")
    views, cards, jobs = _views(spark, d), _cards(spark, d), given.jobs(spark, d)
    runtimes = dashboard.runtime_summary(views)
    return dashboard.filtered_metrics(
        dashboard.overview_metrics(runtimes, jobs, cards),
        dashboard.filter_runtimes(runtimes, views, view),
        dashboard.filter_jobs(jobs, view),
        dashboard.filter_incidents(cards, view),
        view,
    )


@registered(
    sql.to_cards(
        """SELECT b.runtime_key AS busiest_runtime, b.active_sources AS busiest_active, b.running_sources AS busiest_running,
          (SELECT sum(active_sources)::BIGINT FROM runtimes) AS active_sources, (SELECT sum(running_sources)::BIGINT FROM runtimes) AS running_sources,
          u.title AS urgent_title, u.source_name AS urgent_source, (SELECT count(*) FROM cards WHERE severity = 'HIGH') AS high_incidents
        FROM (SELECT * FROM runtimes ORDER BY active_sources * 2 + running_sources DESC, runtime_key LIMIT 1) b,
          (SELECT * FROM cards ORDER BY priority_score DESC, last_seen_at DESC, id LIMIT 1) u""",
        *sql._DIMS,
    )
)
def insights(spark, d):
    views = _views(spark, d)
    runtimes = dashboard.filter_runtimes(dashboard.runtime_summary(views), views, View())
    return dashboard.dashboard_insights(runtimes, _cards(spark, d))
