"""Table schemas (Spark DDL) and the fixed vocabularies of the data model."""

LOG_LINES = (
    "source_type string, source_id string, source_name string, received_at timestamp, "
    "stderr boolean, line string, seq bigint"
)
COMMANDS = (
    "incident_id string, fingerprint string, source_id string, type string, actor string, "
    "note string, ts timestamp, seq bigint"
)
SOURCES = "runtime_key string, id string, name string, status string"
JOBS = (
    "id bigint, runtime_key string, command string, source_ids array<string>, "
    "disposed array<boolean>, started_at timestamp"
)
SUMMARY = (
    "struct<title:string,summary:string,probable_cause:string,suggested_actions:string,severity:string>"
)
INCIDENTS = (
    "id string, fingerprint string, source_id string, source_name string, log_level string, "
    "status string, severity string, first_seen_at timestamp, last_seen_at timestamp, "
    "acknowledged_at timestamp, resolved_at timestamp, total_occurrences bigint, "
    "last_window_count bigint, sample_message string, ai_title string, ai_summary string, "
    "probable_cause string, suggested_actions string, regression_count bigint, tags array<string>"
)
INCIDENT_EVENTS = (
    "id string, incident_id string, type string, created_at timestamp, fingerprint string, source_id string, "
    "source_name string, anomaly_count bigint, severity string, title string, summary string, "
    "probable_cause string, suggested_actions string, sample_message string, actor string, note string, "
    "status string, seq bigint"
)
SAMPLES = "fingerprint string, source_id string, sample string, first_seq bigint"

DEFAULT_SOURCE_TYPE = "DOCKER"

# The vocabularies and weights the results are defined by.
OPERATOR_EVENTS = ["ACKNOWLEDGED", "SUPPRESSED", "RESOLVED", "REGRESSED", "CLOSED"]
SEVERITY_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}
STATUS_WEIGHT = {
    "REGRESSED": 5,
    "OPEN": 4,
    "ACKNOWLEDGED": 3,
    "SUPPRESSED": 2,
    "RESOLVED": 1,
    "CLOSED": 0,
}
MAX_ENTRY_LINES = 500
IDLE_FLUSH_MS = 800
WINDOW_SECONDS = 60
ALERT_THRESHOLD = 20
RETAINED_WINDOWS = 2
STATE_TTL_SECONDS = 30 * 86_400
DASHBOARD_INCIDENTS = 8
SOURCE_PAGE = 20
