"""Event logs, lines by source, what a batch of incidents reads, pauses, and events behind the watermark."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberline.schemas import INCIDENT_EVENTS
from emberline.sources import tables as stored
from emberline.sources.log_lines import read_source, source_bucket, store_by_source
from emberline.streaming.counts import CountStream, OnTimeStream
from emberline.streaming.incidents import IncidentStream, tag_records
from tests.test_counting import NOON, make_events
from tests.test_entries import make_lines
from tests.test_incidents import make_anomalies, make_commands
from tests.test_plans import plan_of


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def event_rows(spark, pairs):
    """(incident, seq) as events."""
    names = [field.split()[0] for field in INCIDENT_EVENTS.split(", ")]
    rows = [tuple({"id": f"e{seq}", "incident_id": incident, "seq": seq}.get(name) for name in names) for incident, seq in pairs]
    return spark.createDataFrame(rows, INCIDENT_EVENTS)


def test_event_log_merges_and_reads_one_bucket(spark, folder):
    log = stored.EventLog(folder, merge=2)
    for batch in range(6):
        rows = event_rows(spark, [(f"i{n % 4}", batch * 10 + n) for n in range(5)])
        for _ in range(2 if batch in (1, 5) else 1):  # a retry changes nothing
            log.append(rows, batch)
    held = log._folders(spark, 5)
    assert len(held) <= 3 and max(klass for _, klass in held) == 2
    assert sorted(r.seq for r in log.read(spark).collect()) == sorted(b * 10 + n for b in range(6) for n in range(5))
    one = log.of_incident(spark, "i3")
    assert sorted(r.seq for r in one.collect()) == [b * 10 + 3 for b in range(6)]
    assert "PartitionFilters: [isnotnull(bucket" in plan_of(one)
    log.append(event_rows(spark, [("new", 7)]), 2)  # an old batch again, with other rows
    assert sorted(r.seq for r in log.read(spark).where("batch_id = 2").collect()) == [7] and log.read(spark).count() == 26
    assert stored.EventLog(f"{folder}/none").of_incident(spark, "x").collect() == []


def test_lines_of_one_source_are_one_folder(spark, folder):
    rows = [(f"s{n % 9}", n, f"line {n}", n) for n in range(60)]
    store_by_source(make_lines(spark, rows), folder)
    one = read_source(spark, folder, "s4")
    assert sorted(r.seq for r in one.collect()) == [n for n in range(60) if n % 9 == 4]
    assert "PartitionFilters: [isnotnull(source_bucket" in plan_of(one) and "PushedFilters: [IsNotNull(source_id)" in plan_of(one)
    assert read_source(spark, folder, "absent").collect() == []
    assert spark.range(1).select(source_bucket(F.lit(None).cast("string"))).first()[0] is not None


def test_a_batch_of_incidents_reads_its_own_buckets(spark, folder, monkeypatch):
    stream = IncidentStream(f"{folder}/i", f"{folder}/e", f"{folder}/r", f"{folder}/s", buckets=16)
    many = make_anomalies(spark, [(f"f{n}", "s", 10, n, f"sample {n}", None) for n in range(40)])
    none = make_commands(spark, [("zz", "s", "CLOSED", 50)])
    stream.process(tag_records(many, none), 0)
    read = []
    whole = stored.KeyedTable.read

    def seen(self, session, version, buckets=None):
        read.append(16 if buckets is None else len(buckets))
        return whole(self, session, version, buckets)

    monkeypatch.setattr(stored.KeyedTable, "read", seen)
    again = make_anomalies(spark, [("f3", "s", 11, 100, "sample 3", None), ("f3", "s", 12, 101, "another", None)])
    command = make_commands(spark, [("f7", "s", "RESOLVED", 102)]).withColumn("fingerprint", F.lit(None).cast("string"))
    stream.process(tag_records(again, command), 1)
    assert max(read) <= 3 and sum(read) < 16
    status = {r.fingerprint: r.status for r in whole(stream.table, spark, 1).collect()}
    assert status["f7"] == "RESOLVED" and len(status) == 40
    new = spark.read.parquet(f"{folder}/s/batch_id=1").collect()
    assert [r.sample for r in new] == ["another"]


def paced(spark, arrivals):
    """Events of one window whose arrivals are so many seconds after noon."""
    rows = make_events(spark, [(fp, "a", "INFO", 0, seq) for seq, (fp, _) in enumerate(arrivals)])
    times = F.create_map(*[F.lit(x) for seq, (_, at) in enumerate(arrivals) for x in (seq, NOON + timedelta(seconds=at))])
    return rows.withColumn("ingest_time", times[F.col("seq").cast("int")])


@pytest.mark.parametrize("cuts", [[0, 8], [0, 3, 8], [0, 2, 5, 8]])
def test_a_pause_starts_anew_wherever_batches_are_cut(spark, folder, cuts):
    arrivals = [("a", 0), ("b", 10), ("a", 90), ("b", 200), ("a", 400), ("a", 410), ("b", 290), ("a", 505)]
    events = paced(spark, arrivals).cache()
    stream = CountStream(f"{folder}/out", f"{folder}/state", 60, ttl_seconds=100, buckets=2)
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        stream.process(events.where((F.col("seq") >= low) & (F.col("seq") < high)), batch)
    found = {r.seq: (r.fingerprint, r.window_count) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert found == {
        0: ("a", 1), 1: ("b", 1), 2: ("a", 2), 3: ("b", 1), 4: ("a", 1), 5: ("a", 2), 6: ("b", 2), 7: ("a", 3),
    }


def test_late_events_are_set_aside(spark, folder):
    stream = OnTimeStream(f"{folder}/out", f"{folder}/late", f"{folder}/newest", 60, 120)
    batches = [[("f", 0), ("f", 500)], [("f", 300), ("f", 350), ("f", 600)], [("f", 430), ("f", 480)]]
    for number, rows in enumerate(batches):
        events = make_events(spark, [(fp, "a", "INFO", at, number * 10 + n) for n, (fp, at) in enumerate(rows)])
        for _ in range(2 if number == 1 else 1):
            stream.process(events, number)
    late = {r.seq for r in spark.read.parquet(f"{folder}/late").collect()}
    # the watermark is 380, then 480; windows of a minute end at 360, 360 and 480
    assert late == {10, 11, 20}
    assert sum(r.window_total for r in stream.totals(spark).collect()) == 4
