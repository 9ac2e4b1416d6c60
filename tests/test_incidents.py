import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from emberline.functions.identity import incident_id
from emberline.operators.incidents import (
    Fold,
    attach_incident,
    find_events,
    fold_incidents,
    incident_samples,
    latest_events,
    resolve_commands,
    rollup_incidents,
)
from emberline.plans.pipeline import incidents_of
from emberline.schemas import COMMANDS, SUMMARY

NOON = datetime(2026, 3, 24, 12, 0, tzinfo=timezone.utc)
ANOMALIES = (
    "fingerprint string, level string, source_id string, source_name string, detected_at timestamp, "
    f"count bigint, sample_message string, seq bigint, summary {SUMMARY}"
)


def at(second):
    return NOON + timedelta(seconds=second)


def naive(second):
    return at(second).replace(tzinfo=None)


def make_anomalies(spark, rows):
    """rows: (fingerprint, source, count, seq, sample, summary title or None)."""
    data = [
        (fp, "ERROR", source, "payments-api", at(seq), count, sample, seq,
         None if title is None else (title, "s", "c", "a", "HIGH"))
        for fp, source, count, seq, sample, title in rows
    ]
    return spark.createDataFrame(data, ANOMALIES)


def make_commands(spark, rows):
    """rows: (fingerprint, source, type, seq)."""
    data = [("x", fp, source, kind, "gui", " note ", at(seq), seq) for fp, source, kind, seq in rows]
    return spark.createDataFrame(data, COMMANDS).withColumn("incident_id", incident_id("fingerprint", "source_id"))


def fold_one_by_one(rows):
    """rows of one key in order: ('ANOMALY', seq, count, sample, title) or (type, seq)."""
    doc, rejected, events = None, [], []
    for row in rows:
        kind, seq = row[0], row[1]
        if kind == "ANOMALY":
            _, _, count, sample, title = row
            if doc is None:
                doc = dict(status="OPEN", total=0, regressions=0, first=seq, ack=None, resolved=None,
                           title="Unknown incident", samples=[])
                events.append(("CREATED", seq, count, title or "Unknown incident"))
            elif doc["status"] in ("RESOLVED", "CLOSED"):
                doc.update(status="REGRESSED", resolved=None, regressions=doc["regressions"] + 1)
            doc.update(total=doc["total"] + count, last=count, seen=seq, title=title or doc["title"])
            if sample not in doc["samples"]:
                doc["samples"].append(sample)
            doc["sample"] = sample
            continue
        if doc is None:
            rejected.append(seq)
            continue
        doc["status"] = kind
        if kind == "ACKNOWLEDGED" and doc["ack"] is None:
            doc["ack"] = seq
        if kind == "RESOLVED" or (kind == "CLOSED" and doc["resolved"] is None):
            doc["resolved"] = seq
        if kind == "REGRESSED":
            doc["resolved"] = None
        events.append((kind, seq, doc["last"], doc["title"]))
    return doc, rejected, events


def test_create_and_regress(spark):
    anomalies = make_anomalies(spark, [("fp-timeout-123", "container-42", 10, 0, "older sample", None),
                                       ("fp-timeout-123", "container-42", 57, 20, "new sample", "Timeouts")])
    first = fold_incidents(anomalies.where("seq = 0")).incidents.first()
    assert (first.status, first.total_occurrences, first.regression_count, first.severity) == ("OPEN", 10, 0, "UNKNOWN")
    assert first.first_seen_at == first.last_seen_at == naive(0) and first.ai_title == "Unknown incident"
    commands = make_commands(spark, [("fp-timeout-123", "container-42", "RESOLVED", 10)])
    fold = fold_incidents(anomalies, commands)
    row = fold.incidents.first()
    assert (row.status, row.regression_count, row.total_occurrences, row.last_window_count) == ("REGRESSED", 1, 67, 57)
    assert row.resolved_at is None and row.severity == "HIGH" and row.sample_message == "new sample"
    assert row.first_seen_at == naive(0) and row.last_seen_at == naive(20)
    samples = incident_samples(anomalies).orderBy("position").collect()
    assert [r["sample"] for r in samples] == ["older sample", "new sample"]


def test_transition_chain(spark):
    anomalies = make_anomalies(spark, [("f", "s", 1, 0, "m", None)])
    for commands, status, acknowledged, resolved in [
        ([("ACKNOWLEDGED", 10), ("ACKNOWLEDGED", 20)], "ACKNOWLEDGED", 10, None),
        ([("SUPPRESSED", 10)], "SUPPRESSED", None, None),
        ([("RESOLVED", 10)], "RESOLVED", None, 10),
        ([("RESOLVED", 10), ("REGRESSED", 20)], "REGRESSED", None, None),
        ([("RESOLVED", 10), ("REGRESSED", 20), ("CLOSED", 30)], "CLOSED", None, 30),
        ([("CLOSED", 10), ("RESOLVED", 20), ("CLOSED", 30)], "CLOSED", None, 20),
    ]:
        given = make_commands(spark, [("f", "s", kind, seq) for kind, seq in commands])
        row = fold_incidents(anomalies, given).incidents.first()
        assert row.status == status
        assert row.acknowledged_at == (None if acknowledged is None else naive(acknowledged))
        assert row.resolved_at == (None if resolved is None else naive(resolved))
        assert row.regression_count == 0


def test_events_carry_the_incident_of_their_moment(spark):
    anomalies = make_anomalies(spark, [("f", "s", 3, 0, "one", "A"), ("f", "s", 4, 20, "two", "B")])
    commands = make_commands(spark, [("f", "s", "ACKNOWLEDGED", 10), ("f", "s", "CLOSED", 30)])
    events = {r.type: r for r in fold_incidents(anomalies, commands).events.collect()}
    created = events["CREATED"]
    assert created.created_at == naive(0) and created.actor is None and created.status is None
    assert (created.anomaly_count, created.title, created.sample_message) == (3, "A", "one")
    assert (events["ACKNOWLEDGED"].title, events["ACKNOWLEDGED"].status) == ("A", "ACKNOWLEDGED")
    assert (events["CLOSED"].title, events["CLOSED"].anomaly_count) == ("B", 4)
    assert events["CLOSED"].note == "note" and events["CLOSED"].actor == "gui"


def random_rows(pick, keys, size):
    rows = {key: [] for key in keys}
    kinds = ["ANOMALY"] * 6 + ["ACKNOWLEDGED", "SUPPRESSED", "RESOLVED", "RESOLVED", "REGRESSED", "CLOSED"]
    for seq in range(size):
        key = keys[0] if pick.random() < 0.35 else pick.choice(keys)
        kind = pick.choice(kinds)
        if kind == "ANOMALY":
            rows[key].append((kind, seq, pick.randint(1, 9), f"m{pick.randint(0, 4)}", pick.choice([None, f"t{seq}"])))
        else:
            rows[key].append((kind, seq))
    return rows


def frames(spark, rows):
    anomalies = [(k[0], k[1], r[2], r[1], r[3], r[4]) for k, rs in rows.items() for r in rs if r[0] == "ANOMALY"]
    commands = [(k[0], k[1], r[0], r[1]) for k, rs in rows.items() for r in rs if r[0] != "ANOMALY"]
    return make_anomalies(spark, anomalies), make_commands(spark, commands)


def snapshot(incidents):
    return {
        (r.fingerprint, r.source_id): (r.status, r.total_occurrences, r.last_window_count, r.regression_count,
                                       r.first_seen_at, r.last_seen_at, r.acknowledged_at, r.resolved_at,
                                       r.ai_title, r.sample_message)
        for r in incidents.collect()
    }


def expected_snapshot(rows):
    time = lambda second: None if second is None else naive(second)
    found = {}
    for key, steps in rows.items():
        doc, _, _ = fold_one_by_one(steps)
        if doc:
            found[key] = (doc["status"], doc["total"], doc["last"], doc["regressions"], time(doc["first"]),
                          time(doc["seen"]), time(doc["ack"]), time(doc["resolved"]), doc["title"], doc["sample"])
    return found


def test_fold_agrees_with_one_by_one(spark):
    keys = [("hot", "a")] + [(f"f{i}", pick) for i in range(20) for pick in ("a", None)]
    rows = random_rows(random.Random(11), keys, 1200)
    anomalies, commands = (frame.cache() for frame in frames(spark, rows))
    for width in (9, 1_000_000):
        steps = fold_incidents(anomalies, commands, slice_width=width).steps.cache()
        fold = Fold(steps)
        assert snapshot(fold.incidents) == expected_snapshot(rows)
        events = {(r.fingerprint, r.source_id, r.type, r.seq, r.anomaly_count, r.title) for r in fold.events.collect()}
        assert events == {(*k, *e) for k, rs in rows.items() for e in fold_one_by_one(rs)[2]}
        assert {r.seq for r in fold.rejected.collect()} == {s for rs in rows.values() for s in fold_one_by_one(rs)[1]}
        steps.unpersist()


def test_continuing_from_stored_incidents_changes_nothing(spark):
    keys = [(f"f{i}", "a") for i in range(25)]
    rows = random_rows(random.Random(5), keys, 500)
    for cut in (100, 333):
        early = frames(spark, {k: [r for r in rs if r[1] < cut] for k, rs in rows.items()})
        late = frames(spark, {k: [r for r in rs if r[1] >= cut] for k, rs in rows.items()})
        prior = fold_incidents(*early).incidents.cache()
        assert snapshot(fold_incidents(*late, prior=prior, slice_width=50).incidents) == expected_snapshot(rows)


def test_command_lookup(spark):
    anomalies = make_anomalies(spark, [("f", "s", 1, 0, "m", None), ("g", None, 1, 0, "m", None)])
    known = rollup_incidents(anomalies)
    rows = [
        (0, "ID:f:s", None, None, "RESOLVED"),
        (1, "nope", "f", "s", "ACKNOWLEDGED"),
        (2, "nope", "f", "s", "CLOSED"),
        (3, "nope", "zz", "s", "ACKNOWLEDGED"),
        (4, "ID:f:s", "f", "s", "CREATED"),
        (5, "ID:f:s", "f", "s", None),
        (6, "nope", "g", None, "ACKNOWLEDGED"),
        (7, "ID:f:s", "g", None, "ACKNOWLEDGED"),
    ]
    frame = spark.createDataFrame(
        [(i, fp, src, kind, None, None, at(9), n) for n, i, fp, src, kind in rows], COMMANDS
    ).withColumn(
        "incident_id",
        F.when(F.col("incident_id") == "ID:f:s", incident_id(F.lit("f"), F.lit("s"))).otherwise(F.col("incident_id")),
    )
    commands = resolve_commands(frame, known)
    assert {r.seq: (r.fingerprint, r.source_id) for r in commands.resolved.collect()} == {
        0: ("f", "s"), 1: ("f", "s"), 6: ("g", None), 7: ("f", "s"),
    }
    assert {r.seq: r.reason for r in commands.rejected.collect()} == {
        2: "incident not found", 3: "incident not found",
        4: "unsupported event type", 5: "unsupported event type",
    }


def test_rejected_commands_do_not_fake_a_regression(spark):
    anomalies = make_anomalies(spark, [("f", "s", 1, 5, "m", None)])
    commands = make_commands(spark, [("f", "s", "RESOLVED", 1)])
    outcome = incidents_of(anomalies, commands)
    row = outcome.fold.incidents.first()
    assert (row.status, row.regression_count) == ("OPEN", 0)
    assert [r.seq for r in outcome.rejected.collect()] == [1]


def test_history(spark):
    anomalies = make_anomalies(spark, [("f", "s", 3, 0, "one", "A"), ("g", "s", 3, 1, "one", "A")])
    commands = make_commands(spark, [("f", "s", "ACKNOWLEDGED", 10), ("f", "s", "CLOSED", 30)])
    fold = fold_incidents(anomalies, commands)
    chosen = fold.incidents.where("fingerprint = 'f'").first().id
    assert [r.type for r in find_events(fold.events, chosen).collect()] == ["CLOSED", "ACKNOWLEDGED", "CREATED"]
    assert [r.type for r in find_events(fold.events, chosen, "CREATED").collect()] == ["CREATED"]
    assert {r.incident_id: r.type for r in latest_events(fold.events).collect()}[chosen] == "CLOSED"


def test_attach_incident_keeps_unmatched(spark):
    anomalies = make_anomalies(spark, [("f", None, 3, 0, "one", None), ("g", "s", 3, 1, "one", None)])
    stored = fold_incidents(anomalies.where("fingerprint = 'f'")).incidents
    found = {r.fingerprint: r.incident_status for r in attach_incident(anomalies, stored).collect()}
    assert found == {"f": "OPEN", "g": None}


def test_samples_are_distinct_and_ordered_across_slices(spark):
    rows = [("f", "s", 1, seq, f"m{(seq * 7) % 40}" if seq % 5 else "  ", None) for seq in range(200)]
    expected, seen = [], set()
    for _, _, _, _, sample, _ in rows:
        if sample.strip() and sample not in seen:
            seen.add(sample)
            expected.append(sample)
    found = incident_samples(make_anomalies(spark, rows), slice_width=6).orderBy("position").collect()
    assert [r["sample"] for r in found] == expected
    assert [r["position"] for r in found] == list(range(1, len(expected) + 1))
