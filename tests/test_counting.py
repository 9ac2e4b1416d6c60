import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from emberline.operators.counting import (
    anomalies_of_counted,
    detect_anomalies,
    window_counts,
    with_running_count,
)

SCHEMA = (
    "source_id string, source_name string, ingest_time timestamp, event_time timestamp, "
    "level string, message string, seq bigint, fingerprint string"
)
NOON = datetime(2026, 3, 21, 12, 0, tzinfo=timezone.utc)


def make_events(spark, rows):
    """rows: (fingerprint, source, level, seconds after noon or None, seq)."""
    data = [
        (source, None, NOON, None if at is None else NOON + timedelta(seconds=at), level, f"m{seq}", seq, fp)
        for fp, source, level, at, seq in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


def one_by_one(rows, width=60):
    """Counts by seq, the late rule applied after every event: windows held per fingerprint."""
    held, found = {}, {}
    for fp, _, _, at, seq in rows:
        start = None if at is None else at // width * width
        windows = held.setdefault(fp, {})
        windows[start] = windows.get(start, 0) + 1
        found[seq] = windows[start]
        if start is not None and len([w for w in windows if w is not None]) > 3:
            held[fp] = {w: n for w, n in windows.items() if w is None or w >= start - 2 * width}
    return found


def counts(frame):
    return {row.seq: row.window_count for row in frame.collect()}


def test_window_boundaries(spark):
    events = make_events(spark, [("fp", "a", "INFO", s, i) for i, s in enumerate([29, 30, 61])])
    assert counts(with_running_count(events, 60)) == {0: 1, 1: 2, 2: 1}


def test_threshold_is_strict_and_every_event_fires(spark):
    events = make_events(spark, [("fp", "a", "ERROR", 0, i) for i in range(5)])
    assert sorted(r["count"] for r in detect_anomalies(events, 60, 3).collect()) == [4, 5]
    counted = with_running_count(events, 60)
    assert sorted(r["count"] for r in anomalies_of_counted(counted, 3).collect()) == [4, 5]


def test_all_levels_count_but_only_errors_alert(spark):
    rows = [("fp", "a", "INFO", 0, 0), ("fp", "a", "INFO", 0, 1), ("fp", "a", "ERROR", 0, 2), ("fp", "a", "INFO", 0, 3)]
    found = detect_anomalies(make_events(spark, rows), 60, 2).collect()
    assert [(r.seq, r["count"]) for r in found] == [(2, 3)]


def test_counts_are_shared_between_sources(spark):
    rows = [("fp", "a", "ERROR", 0, 1), ("fp", "b", "ERROR", 0, 2), ("fp", "a", "ERROR", 0, 3), ("fp", "b", "ERROR", 0, 4)]
    found = detect_anomalies(make_events(spark, rows), 60, 3).collect()
    assert [(r.source_id, r["count"]) for r in found] == [("b", 4)]


def test_missing_event_time_uses_arrival(spark):
    events = make_events(spark, [("fp", "a", "INFO", None, 1), ("fp", "a", "INFO", 10, 2)])
    assert counts(with_running_count(events, 60)) == {1: 1, 2: 2}


def test_slices_agree_with_counting_one_by_one(spark):
    pick = random.Random(3)
    rows = []
    for seq in range(800):
        fp = pick.choice(["hot", "hot", "hot", "b", "c"])
        rows.append((fp, pick.choice("xyz"), pick.choice(["ERROR", "INFO"]), pick.randint(0, 240), seq))
    expected = one_by_one(rows)
    alerts = {(seq, expected[seq]) for _, _, level, _, seq in rows if level == "ERROR" and expected[seq] > 20}
    events = make_events(spark, rows).cache()
    for width in (1, 13, 1_000_000):
        assert counts(with_running_count(events, 60, width)) == expected
        found = detect_anomalies(events, 60, 20, slice_width=width).collect()
        assert {(r.seq, r["count"]) for r in found} == alerts
    totals = Counter((fp, at // 60) for fp, _, _, at, _ in rows)
    assert sorted(r.window_total for r in window_counts(events, 60).collect()) == sorted(totals.values())


def test_late_events_restart_as_one_by_one(spark):
    pick = random.Random(8)
    rows = []
    for seq in range(600):
        at = seq // 6 * 20 - pick.choice([0, 0, 0, 0, 0, 0, 0, 60, 130, 400])
        rows.append((pick.choice("abbb"), "s", "INFO", None if seq % 50 == 0 else at, seq))
    rows += [("calm", "s", "INFO", seq, seq) for seq in range(600, 900)]
    rows = [(fp, s, lv, 0 if at is None else at, q) for fp, s, lv, at, q in rows]
    expected = one_by_one(rows)
    for width in (7, 1_000_000):
        assert counts(with_running_count(make_events(spark, rows), 60, width)) == expected
    sequence = make_events(spark, [("fp", "a", "INFO", s, i) for i, s in enumerate([0, 60, 120, 180, 0, 0, 185, 0])])
    assert counts(with_running_count(sequence, 60)) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 1}
