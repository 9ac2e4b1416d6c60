import os
import shutil
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators.entries import log_entries, segment_entries
from emberline.schemas import LOG_LINES
from emberline.sources import tables as stored
from emberline.operators.lateness import STATE
from emberline.operators.incidents import numbered_samples
from emberline.streaming.counts import CountStream, count_batch
from emberline.streaming.entries import EntryStream, split_open
from emberline.streaming.incidents import IncidentStream, tag_records
from emberline.streaming.stateful import stateful_running_count
from tests.test_counting import make_events, one_by_one
from tests.test_entries import START, make_lines
from tests.test_incidents import make_anomalies, make_commands


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_open_part_waits_for_a_pause_or_more_lines(spark):
    lines = make_lines(spark, [("s", 1, "a", 0), ("s", 2, " b", 1), ("t", 3, "x", 0), ("t", 4, "y", 5000)])
    now = START + timedelta(milliseconds=5100)
    finished, opened = split_open(segment_entries(lines), now)
    assert {r.message for r in finished.collect()} == {"a\n b", "x"}
    assert [r.line for r in opened.collect()] == ["y"]
    finished, opened = split_open(segment_entries(lines), None)
    assert {r.message for r in finished.collect()} == {"x"} and opened.count() == 3
    # A full part is finished although nothing follows it.
    finished, opened = split_open(segment_entries(lines, 2), None, max_lines=2)
    assert {r.message for r in finished.collect()} == {"a\n b", "x"}


def test_entries_of_batches_equal_entries_of_the_whole(spark, folder):
    rows = [("s", n, ["head", " more", "at f()"][n % 3] if n % 7 else "", n * 10) for n in range(1, 40)]
    rows += [("t", n, "    part of a long trace", 0) for n in range(100, 112)]
    rows.sort(key=lambda row: row[1])
    stream = EntryStream(f"{folder}/out", f"{folder}/open", max_lines=4, idle_ms=800, use_clock=False)
    cuts = [0, 9, 10, 30, len(rows)]
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if batch == 1 else 1):  # a retry changes nothing
            stream.process(make_lines(spark, rows[low:high]), batch)
    stream.flush(spark)
    found = sorted((r.source_id, r.entry_seq, r.message) for r in spark.read.parquet(f"{folder}/out").collect())
    whole = log_entries(make_lines(spark, rows), 4, 800)
    assert found == sorted((r.source_id, r.entry_seq, r.message) for r in whole.collect())


def late_rows(number=60):
    return [("fp" if n % 3 else "other", "a", "ERROR", n * 11 - (400 if n % 7 == 0 else 0), n) for n in range(number)]


@pytest.mark.parametrize("cuts", [[0, 60], [0, 20, 40, 60], [0, 1, 7, 8, 33, 59, 60]])
def test_counts_do_not_depend_on_where_batches_are_cut(spark, folder, cuts):
    rows = late_rows()
    stream = CountStream(f"{folder}/out", f"{folder}/state", 60, buckets=3)
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if batch == 1 else 1):  # a retry changes nothing
            stream.process(make_events(spark, rows[low:high]), batch)
    found = {r.seq: r.window_count for r in spark.read.parquet(f"{folder}/out").collect()}
    assert found == one_by_one(rows)


def test_old_windows_are_forgotten_and_late_events_restart(spark):
    for cuts in ([0, 1, 2, 3, 4, 5], [0, 5], [0, 4, 5], [0, 2, 5]):
        state = spark.createDataFrame([], STATE)
        results = []
        for low, high in zip(cuts, cuts[1:]):
            seconds = list(enumerate([0, 60, 120, 180, 0]))[low:high]
            batch = make_events(spark, [("fp", "a", "INFO", second, seq) for seq, second in seconds])
            counted, held = count_batch(state, batch, 60)
            results += [r.window_count for r in counted.orderBy("seq").collect()]
            state = spark.createDataFrame(held.collect(), STATE)
        assert results == [1, 1, 1, 1, 1], cuts


def test_idle_fingerprints_expire_by_arrival(spark, folder):
    """A record dated far ahead forgets nobody; a fingerprint that has not arrived for long is forgotten."""
    ahead = make_events(spark, [("old", "a", "INFO", 0, 0), ("ahead", "a", "INFO", 10**9, 1)])
    stream = CountStream(f"{folder}/out", f"{folder}/state", 60, ttl_seconds=300, buckets=1)
    stream.process(ahead, 0)
    later = make_events(spark, [("new", "a", "INFO", 0, 2)]).withColumn(
        "ingest_time", F.col("ingest_time") + F.expr("interval 200 seconds")
    )
    stream.process(later, 1)
    names = lambda version: sorted(r.fingerprint for r in stream.table.read(spark, version).collect())
    assert names(1) == ["ahead", "new", "old"]
    stream.process(later.withColumn("ingest_time", F.col("ingest_time") + F.expr("interval 200 seconds")), 2)
    assert names(2) == ["new"]


def test_absent_state_is_an_error(spark, folder):
    stream = CountStream(f"{folder}/out", f"{folder}/state", 60, buckets=2)
    for batch in range(3):
        stream.process(make_events(spark, late_rows(9)[batch * 3 : batch * 3 + 3]), batch)
    shutil.rmtree(f"{folder}/state/manifest/v=2")
    with pytest.raises(stored.MissingSnapshot):
        stream.process(make_events(spark, late_rows(3)), 3)
    with pytest.raises(stored.MissingSnapshot):  # a new checkpoint on the old table
        stream.process(make_events(spark, late_rows(3)), 0)
    with pytest.raises(stored.MissingSnapshot):
        EntryStream(f"{folder}/o", f"{folder}/nothing").process(make_lines(spark, [("s", 1, "a", 0)]), 4)


def test_a_batch_leaves_other_buckets_alone(spark, folder):
    table = stored.KeyedTable(f"{folder}/t", "k string, n int", ("k",), buckets=8, keep=2)
    rows = lambda n, keys: spark.createDataFrame([(k, n) for k in keys], "k string, n int")
    keys = [f"k{i}" for i in range(40)]
    table.write(rows(0, keys), 0, table.touched(rows(0, keys)))
    one = rows(1, ["k5"])
    touched = table.touched(one)
    assert len(touched) == 1
    read = table.read(spark, 0, touched)
    assert {file.split("bucket=")[1].split("/")[0] for file in read.inputFiles()} == {str(touched[0])}
    kept = read.where("k != 'k5'").unionByName(one)
    table.write(kept, 1, touched)
    written = [name for name in os.listdir(f"{folder}/t/rows/v=1") if name.startswith("bucket=")]
    assert written == [f"bucket={touched[0]}"]
    now = {r.k: r.n for r in table.read(spark, 1).collect()}
    assert now == {k: int(k == "k5") for k in keys}
    for version in (2, 3):
        table.write(table.read(spark, version - 1, touched), version, touched)
    assert {r.k: r.n for r in table.read(spark, 3).collect()} == now
    # the bucket that moved on is gone from the versions that no kept manifest names
    assert not os.path.exists(f"{folder}/t/rows/v=1") and f"bucket={touched[0]}" not in os.listdir(f"{folder}/t/rows/v=0")
    table.write(spark.createDataFrame([], "k string, n int"), 4, touched)
    assert table.read(spark, 4, touched).count() == 0 and table.read(spark, 4).count() < 40


def test_a_quiet_stream_gives_its_last_entry(spark, folder):
    """Only the heartbeat goes on after the first batch, in which the last entry is still open."""
    ahead = make_lines(spark, [("s", 1, "ERROR", 0), ("s", 2, "  at f()", 0)]).withColumn(
        "received_at", F.current_timestamp()
    )
    ahead.write.parquet(f"{folder}/lines")
    source = spark.readStream.schema(LOG_LINES).parquet(f"{folder}/lines")
    stream = EntryStream(f"{folder}/out", f"{folder}/open", idle_ms=20_000)
    query = stream.start(source, f"{folder}/c", heartbeat_rows=1, processingTime="2 seconds")
    try:
        early, found, end = None, [], time.time() + 90
        while time.time() < end and not found:
            time.sleep(1)
            if os.path.exists(f"{folder}/out/batch_id=0/_SUCCESS"):
                found = [r.message for r in spark.read.parquet(f"{folder}/out").collect()]
                early = early or spark.read.parquet(f"{folder}/out/batch_id=0").count()
        assert found == ["ERROR\n  at f()"] and not early
    finally:
        query.stop()


def test_stateful_counts_apply_the_rule_per_event(spark, folder):
    rows = [("fp", "a", "INFO", s, n) for n, s in enumerate([0, 60, 120, 180, 0, 185])]
    make_events(spark, rows).coalesce(1).write.parquet(f"{folder}/in")
    events = spark.readStream.schema(make_events(spark, rows).schema).parquet(f"{folder}/in")
    query = (
        stateful_running_count(events, 60)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    found = {r.seq: r.window_count for r in spark.read.parquet(f"{folder}/out").collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2}


def test_incidents_over_batches(spark, folder):
    anomalies = make_anomalies(spark, [("f", "s", 10, 0, "one", "A"), ("f", "s", 57, 20, "two", None), ("f", "s", 3, 25, "one", None)])
    commands = make_commands(spark, [("f", "s", "RESOLVED", 10), ("zz", "s", "CLOSED", 11)])
    stream = IncidentStream(f"{folder}/i", f"{folder}/e", f"{folder}/r", f"{folder}/s", buckets=4)
    for batch, (low, high) in enumerate([(0, 5), (5, 15), (15, 99)]):
        chosen = (F.col("seq") >= low) & (F.col("seq") < high)
        records = tag_records(anomalies.where(chosen), commands.where(chosen))
        for _ in range(2 if batch == 1 else 1):
            stream.process(records, batch)
    assert stream.table.latest(spark) == 2
    row = stream.table.read(spark, 2).first()
    assert (row.status, row.total_occurrences, row.regression_count, row.ai_title) == ("REGRESSED", 70, 1, "A")
    events = stored.read_incident_events(spark, f"{folder}/e").orderBy("seq").collect()
    assert [(r.type, r.seq) for r in events] == [("CREATED", 0), ("RESOLVED", 10)]
    assert [r.seq for r in spark.read.parquet(f"{folder}/r").collect()] == [11]
    samples = numbered_samples(stored.read_samples(spark, f"{folder}/s")).orderBy("position").collect()
    assert [(r.sample, r.first_seq) for r in samples] == [("one", 0), ("two", 20)]
    assert stored.read_incident_events(spark, f"{folder}/none").count() == 0


def test_stream_uses_its_checkpoint(spark, folder):
    lines = make_lines(spark, [("s", 1, "a", 0), ("s", 2, "b", 0)])
    lines.write.parquet(f"{folder}/lines")
    source = spark.readStream.schema(LOG_LINES).parquet(f"{folder}/lines")
    stream = EntryStream(f"{folder}/out", f"{folder}/open")
    stream.start(source, f"{folder}/checkpoint").awaitTermination()
    stream.start(source, f"{folder}/checkpoint").awaitTermination()
    # The lines are long past their pause, so both entries are out, once each.
    assert sorted(r.message for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b"]
