"""Steps that many queries share do their work once, and over all tasks."""

import datetime as dt
import os

from pyspark.sql import functions as F

from emberline.functions import identity
from emberline.functions.times import TEXT_TIME
from emberline.operators import counting, lateness
from emberline.operators.entries import assemble_entries, segment_entries
from emberline.operators.parsing import log_events, parse_entries
from emberline.schemas import LOG_LINES
from emberline.sources.tables import read_version
from emberline.streaming.entries import EntryStream, split_open
from querybook import queries, tables

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def test_anomalies_are_found_once(spark, tmp_path, monkeypatch):
    at = dt.datetime(2024, 1, 1)
    rows = [(n, at + dt.timedelta(minutes=n), 7, "view" if n == 9 else "error", 20.0) for n in range(12)]
    spark.createDataFrame([*rows, rows[11]], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    calls, plain = [], tables.staged_anomalies
    monkeypatch.setattr(tables, "staged_anomalies", lambda *given: calls.append(1) or plain(*given))
    found = queries.attach_incident(spark, str(tmp_path)).collect()
    assert len(calls) == 1
    anomalies = tables.anomalies(spark, str(tmp_path)).count()
    assert len(found) == anomalies > 0 and all(row.incident_id for row in found)


def test_fold_of_few_bytes_takes_all_tasks(spark):
    runs = spark.createDataFrame([(f"f{n % 40}", n, "s", n % 5 * 60) for n in range(400)], lateness.STATE.split(",")[0] + ", seq bigint, source_id string, _second bigint")
    folded = lateness._folded(runs, None, None, 60, 1000, 100)
    assert folded.count() == 40
    assert folded.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_times_are_looked_for_once(spark):
    schema = "source_type string, source_id string, source_name string, seen timestamp, message string, entry_seq bigint"
    entries = spark.createDataFrame([("D", "s", None, None, "2024-01-01 10:00:00 ERROR x 1", 1)], schema)
    parsed = parse_entries(entries)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count(TEXT_TIME[:30]) == 1
    assert log_events(entries).select("level", F.unix_seconds("event_time")).first() == ("ERROR", 1704103200)


def test_skipped_rules_find_nothing(spark, strings):
    pieces = ["a1b2c3d4", "-", "-e5f6-", "12.34.5.6", "1.2.3", "deadbeefdeadbeef", "x", " ", "\t\n", "é9", "7", "_", "."]
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    texts = [a + b + c for a in [*pieces, uuid] for b in pieces for c in [*pieces, uuid]]
    whole = strings(texts, lambda c: F.when(identity.is_blank(c), "").otherwise(identity.trimmed(identity._scrub(F.col(c), identity.SCRUB))))
    assert strings(texts, identity.normalize_message) == whole


def test_open_parts_are_found_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("D", f"s{n % 3}", None, at, False, line, n) for n, line in enumerate(["a", "b", "c", "  at x", "d", "e", "f"])]
    lines = spark.createDataFrame(rows, LOG_LINES)
    stream = EntryStream(f"{tmp_path}/out", f"{tmp_path}/state", use_clock=False)
    stream.process(lines, 0)
    assert os.path.exists(f"{tmp_path}/state-open/v=0/_SUCCESS")
    finished, opened = split_open(segment_entries(lines), None)
    written = spark.read.parquet(f"{tmp_path}/out/batch_id=0")
    assert sorted(written.select("source_id", "message").collect()) == sorted(finished.select("source_id", "message").collect())
    held = read_version(spark, f"{tmp_path}/state", 0, LOG_LINES)
    assert sorted(r.seq for r in held.collect()) == sorted(r.seq for r in opened.collect()) == [4, 5, 6]


def test_late_rule_sees_failing_fingerprints_only(spark, monkeypatch):
    schema = "source_type string, source_id string, source_name string, ingest_time timestamp, event_time timestamp, level string, message string, fingerprint string, seq bigint"
    at = dt.datetime(2024, 1, 1)
    levels = {"bad": ["ERROR"] * 4, "mixed": ["INFO", "INFO", "INFO", "ERROR"], "good": ["INFO"] * 4, None: ["ERROR"] * 4}
    rows = [("D", "s", None, at, at, level, "m", name, 10 * n + k) for k, (name, all_) in enumerate(levels.items()) for n, level in enumerate(all_)]
    seen, plain = [], counting.fold_windows
    monkeypatch.setattr(counting, "fold_windows", lambda given, *more: seen.append(given) or plain(given, *more))
    found = counting.detect_anomalies(spark.createDataFrame(rows, schema), 60, 2)
    assert sorted((r.fingerprint or "", r["count"]) for r in found.collect()) == [("", 3), ("", 4), ("bad", 3), ("bad", 4), ("mixed", 4)]
    assert {r.fingerprint for r in seen[0].collect()} == {"bad", "mixed", None}


def test_entries_take_all_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = dt.datetime(2024, 1, 1)
    lines = spark.createDataFrame([("D", f"s{n % 3}", None, at, False, f"line {n}", n) for n in range(20)], LOG_LINES)
    segmented = segment_entries(lines)
    assert segmented.rdd.getNumPartitions() == tasks
    assert assemble_entries(segmented).rdd.getNumPartitions() == tasks
