"""Arrival numbers across micro-batches, committed outputs, and the stream from lines to incidents."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators.counting import detect_anomalies
from emberline.operators.notifications import NotificationSettings
from emberline.plans.pipeline import Settings, events_of, incidents_of
from emberline.schemas import COMMANDS, INCIDENTS, LOG_LINES
from emberline.sources import tables as stored
from emberline.sources.arrivals import ArrivalStream
from emberline.streaming.chain import LogChain, tag_inputs
from tests.test_entries import START

SETTINGS = Settings(window_seconds=60, threshold=3)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def some_lines(number=240, seed=2):
    """(source, seq, line, seconds): errors with traces, late ones among them, from two sources."""
    pick, rows = random.Random(seed), []
    for n in range(number):
        second = n * 5 - (400 if n % 17 == 0 else 0)
        stamp = (START + timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S")
        head = f"{stamp},000 {pick.choice(['ERROR', 'ERROR', 'INFO'])} [{pick.choice(['auth', 'billing'])}] request failed user={n}"
        source = pick.choice(["a", "a", "b"])
        rows.append((source, n * 10, head, n * 5))
        rows += [(source, n * 10 + k, f"    at app.Handler.run(Handler.java:{n})", n * 5) for k in range(1, pick.randrange(1, 4))]
    return rows


def line_frame(spark, rows):
    made = [("DOCKER", source, None, START + timedelta(seconds=at), False, line, seq) for source, seq, line, at in rows]
    return spark.createDataFrame(made, LOG_LINES)


def command_frame(spark, rows):
    return spark.createDataFrame([(None, f, s, kind, "gui", None, START, seq) for f, s, kind, seq in rows], COMMANDS)


def outcome(spark, lines, commands):
    found = detect_anomalies(events_of(lines, SETTINGS), 60, 3)
    made = incidents_of(found, commands)
    return sorted(map(str, made.fold.incidents.collect())), sorted((r.type, r.seq, r.incident_id) for r in made.fold.events.collect()), found


def test_chain_equals_one_run_over_everything(spark, folder):
    """Cut in the middle of an entry, one batch retried."""
    rows, cuts = some_lines(150), [0, 501, 10_000]
    lines = line_frame(spark, rows)
    events = events_of(lines, SETTINGS).cache()
    known = sorted({(r.fingerprint, r.source_id) for r in detect_anomalies(events, 60, 3).collect()})
    orders = [(f, s, kind, 10 * n + 5) for n, ((f, s), kind) in enumerate(zip(known * 20, ["RESOLVED", "ACKNOWLEDGED", "CLOSED", "SUPPRESSED"] * 40)) if n % 3 == 0]
    commands = command_frame(spark, orders).withColumn("incident_id", F.lit(None).cast("string"))
    whole, history, found = outcome(spark, lines, commands)
    mail = NotificationSettings(to="a@x.org", sender="w@x.org")
    chain = LogChain(folder, SETTINGS, buckets=3, mail=mail)
    inputs = tag_inputs(lines, commands).withColumn("at", F.coalesce("line.seq", "command.seq"))
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = inputs.where((F.col("at") >= low) & (F.col("at") < high)).drop("at")
        for _ in range(2 if batch == 1 else 1):  # a retry changes nothing
            chain.process(part, batch)
    chain.flush(spark)
    table = chain.incidents.table
    made = table.read(spark, table.latest(spark))
    assert sorted(map(str, made.select(*[field.split()[0] for field in INCIDENTS.split(", ")]).collect())) == whole
    kept = stored.read_incident_events(spark, chain.incidents.events).collect()
    assert sorted((r.type, r.seq, r.incident_id) for r in kept) == history
    sent = [(r.incident_id, r.seq) for r in chain.notifications(spark).collect()]
    assert len(sent) == len(set(sent)) == found.count()


def test_a_retry_after_any_step_goes_on_from_there(spark, folder):
    rows = some_lines(60)
    lines, commands = line_frame(spark, rows), command_frame(spark, [])
    whole, history, _ = outcome(spark, lines, commands)
    chain = LogChain(folder, SETTINGS, buckets=2)

    class Lost(RuntimeError):
        pass

    for number, steps in enumerate([["_release", "_detect"], ["_inputs", "_entries", "_count", "_fold"]]):
        part = tag_inputs(lines.where((F.col("seq") >= 300) == (number == 1)), commands)
        for step in steps:

            def fail(self, *args, _work=getattr(LogChain, step), **named):
                _work(self, *args, **named)
                raise Lost  # written, but not committed

            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(LogChain, step, fail)
                with pytest.raises(Lost):
                    chain.process(part, number)
        chain.process(part, number)
    chain.flush(spark)
    table = chain.incidents.table
    assert sorted(map(str, table.read(spark, table.latest(spark)).collect())) == whole


def test_numbers_go_on_from_batch_to_batch(spark, folder):
    rows = [("b", 0, "x", 5), ("a", 7, "y", 5), ("a", 3, "z", 1), ("c", 0, "w", 0)]
    stream = ArrivalStream(f"{folder}/lines", f"{folder}/next")
    stream.process(line_frame(spark, rows), 0)
    for _ in range(2):  # a retry gives the numbers it gave before
        stream.process(line_frame(spark, [("a", 8, "late", 2), ("b", 1, "v", 9)]), 1)
    stream.process(line_frame(spark, []), 2)
    stream.process(line_frame(spark, [("b", 2, "u", 3)]), 3)
    made = stored.CommittedOutput(f"{folder}/lines").read(spark, f"{LOG_LINES}, source_seq bigint")
    numbers = {r.seq: (r.line, r.source_seq) for r in made.collect()}
    assert numbers == {0: ("w", 0), 1: ("z", 3), 2: ("y", 7), 3: ("x", 0), 4: ("late", 8), 5: ("v", 1), 6: ("u", 2)}


def test_readers_see_complete_batches_only(spark, folder):
    output = stored.CommittedOutput(folder)
    output.write(spark.createDataFrame([(1,)], "n int"), 0)
    assert output.read(spark, "n int").collect() == []
    with pytest.raises(stored.MissingSnapshot):
        output.batch(spark, 0, "n int")
    output.commit(spark, 0)
    output.write(spark.createDataFrame([(2,)], "n int"), 1)
    assert [r.n for r in output.read(spark, "n int").collect()] == [1]


def test_renumbered_inputs_follow_their_arrival(spark, folder):
    rows = some_lines(40)
    lines = line_frame(spark, rows)
    offsets = lines.withColumn("seq", F.col("seq") % 1_000)  # each source's own numbers only
    chain = LogChain(folder, SETTINGS, buckets=2, renumber=True)
    for batch, (low, high) in enumerate([(0, 120), (120, 10**9)]):
        part = offsets.where(F.unix_seconds("received_at") - START.timestamp() >= low).where(F.unix_seconds("received_at") - START.timestamp() < high)
        chain.process(tag_inputs(part, command_frame(spark, [])), batch)
    chain.flush(spark)
    numbered = [chain.output("inputs").batch(spark, batch, "line struct<seq:bigint>") for batch in (0, 1)]
    seen = sorted(r[0] for frame in numbered for r in frame.select("line.seq").collect())
    assert seen == list(range(len(rows)))
