import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from emberline.operators.entries import is_entry_start, log_entries
from emberline.schemas import LOG_LINES

START = datetime(2026, 3, 21, 12, 0, tzinfo=timezone.utc)


def make_lines(spark, rows):
    """rows: (source, seq, line, milliseconds)."""
    data = [
        ("DOCKER", source, None, START + timedelta(milliseconds=ms), False, line, seq)
        for source, seq, line, ms in rows
    ]
    return spark.createDataFrame(data, LOG_LINES)


def messages(frame):
    return [(r.source_id, r.entry_seq, r.message) for r in frame.orderBy("entry_seq").collect()]


def starts(line):
    if line is None or line == "":
        return True
    return not (line.strip() == "" or line.startswith((" ", "\t", "at ", "Caused by:", "...")))


def sequential(rows, max_lines, idle_ms):
    """A buffer per source, line by line."""
    open_lines, done = {}, []

    def flush(source):
        lines = open_lines.pop(source, [])
        if lines:
            done.append((source, lines[0][0], "\n".join("null" if l is None else l for _, l, _ in lines)))

    for source, seq, line, ms in sorted(rows, key=lambda row: row[1]):
        held = open_lines.get(source, [])
        if held and (starts(line) or (idle_ms is not None and ms - held[-1][2] >= idle_ms)):
            flush(source)
        open_lines.setdefault(source, []).append((seq, line, ms))
        if len(open_lines[source]) >= max_lines:
            flush(source)
    for source in list(open_lines):
        flush(source)
    return sorted(done, key=lambda entry: entry[1])


def test_stack_trace_joins_its_header(spark):
    rows = [
        ("c-1", 1, "2026-03-21 12:00:00 ERROR top level", 0),
        ("c-1", 2, "    at app.Service.method(Service.java:42)", 0),
        ("c-1", 3, "Caused by: java.lang.IllegalStateException", 0),
        ("c-1", 4, "2026-03-21 12:00:01 INFO recovered", 0),
    ]
    found = messages(log_entries(make_lines(spark, rows), 500, 10_000))
    assert [m for _, _, m in found] == ["\n".join(row[2] for row in rows[:3]), rows[3][2]]


def test_empty_line_opens_and_blank_line_continues(spark):
    rows = [("s", 1, "a", 0), ("s", 2, "", 0), ("s", 3, "   ", 0), ("t", 4, None, 0)]
    assert messages(log_entries(make_lines(spark, rows))) == [("s", 1, "a"), ("s", 2, "\n   "), ("t", 4, "null")]


def test_max_lines_splits(spark):
    rows = [("s", 1, "a", 0), ("s", 2, " b", 0), ("s", 3, " c", 0), ("s", 4, " d", 0)]
    assert messages(log_entries(make_lines(spark, rows), 2)) == [("s", 1, "a\n b"), ("s", 3, " c\n d")]


def test_pause_closes_an_entry(spark):
    rows = [("s", 1, "a", 0), ("s", 2, " b", 799), ("s", 3, " c", 1599)]
    assert [m for _, _, m in messages(log_entries(make_lines(spark, rows)))] == ["a\n b", " c"]


def test_start_flags(strings):
    lines = ["at x", "attic", "Caused by: y", "... 3 more", "　", " ", "x", "\tx"]
    assert strings(lines, is_entry_start) == [False, True, False, False, False, True, True, False]


def test_slices_agree_with_a_sequential_buffer(spark):
    pick = random.Random(7)
    choices = ["head", "", "   ", " more", "at f()", "Caused by: z", "...", None, "INFO ok"]
    rows, ms = [], 0
    for seq in range(1, 900):
        # One source holds about two thirds of all lines.
        source = pick.choice(["hot", "hot", "hot", "hot", "b", None])
        ms += pick.choice([0, 1, 50, 900])
        weight = [2, 1, 2, 8, 8, 4, 2, 1, 1]
        rows.append((source, seq, pick.choices(choices, weight)[0], ms))
    lines = make_lines(spark, rows).cache()
    for width, max_lines, idle in [(7, 3, 800), (40, 500, None), (1, 4, 900), (1_000_000, 5, 100)]:
        expected = sequential(rows, max_lines, idle)
        assert messages(log_entries(lines, max_lines, idle, width)) == expected, (width, max_lines, idle)


def test_first_line_gives_source_and_time(spark):
    rows = [("s", 1, "a", 5), ("s", 2, " b", 10)]
    lines = make_lines(spark, rows).withColumn("source_name", F.lit("web"))
    entry = log_entries(lines).first()
    assert entry.source_name == "web" and entry.source_type == "DOCKER"
    assert entry.seen.replace(tzinfo=timezone.utc) == START + timedelta(milliseconds=5) and entry.line_count == 2
