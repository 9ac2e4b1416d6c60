import hashlib
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from emberline.functions import identity, levels, text, times
from emberline.operators import parsing


def test_blank_follows_java(strings):
    values = [None, "", " \t\n", "\x1c　", " ", " ", "a", " \u0085"]
    assert strings(values, text.is_blank) == [True, True, True, True, False, False, False, False]


def test_safe_and_abbreviate(strings):
    assert strings([None, "  ", " a "], text.safe) == ["unknown", "unknown", "a"]
    assert strings(["x" * 120, "x" * 121], lambda c: text.abbreviate(c, 120)) == ["x" * 120, "x" * 117 + "..."]
    assert strings([" ", "a" * 31], lambda c: text.shorten(c, 30)) == ["unknown", "a" * 27 + "..."]


def test_escape_slug_and_notes(strings):
    assert strings(["<a href=\"x\">&'"], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]
    assert strings([" a\nb ", None], text.html_paragraphs) == ["a<br/>b", "unknown"]
    assert strings([" Up 3 hours (healthy)", None, ""], text.badge_slug) == ["up-3-hours-healthy-", "unknown", "unknown"]
    assert strings(["  ", " n "], text.trim_to_null) == [None, "n"]
    assert strings([" Docker ", "  "], text.runtime_key) == ["docker", None]


def test_recipients(spark):
    row = spark.range(1).select(text.split_recipients("a@x, ,b@y ,").alias("r")).first()
    assert row.r == ["a@x", "b@y"]


def test_text_levels(strings):
    cases = {
        "MY_ERROR": "ERROR",
        "IllegalStateException": "UNKNOWN",
        "java.lang.Exception": "ERROR",
        "error5": "UNKNOWN",
        "[warning]": "WARN",
        "FATAL x": "UNKNOWN",
        "warn then error": "ERROR",
        "trace exception": "TRACE",
        "ınfo": "INFO",
        "éERROR": "UNKNOWN",
        "": "UNKNOWN",
        "debug": "DEBUG",
    }
    assert strings(list(cases), levels.text_level) == list(cases.values())


def test_text_times(strings):
    cases = {
        "2026-03-21 12:00:00,123 ERROR x": "2026-03-21 12:00:00.123000",
        "2026-03-21T14:00:00+02:00 INFO": "2026-03-21 12:00:00.000000",
        "2026-03-21 12:00:00.123456+02:00": "2026-03-21 12:00:00.000000",
        "2026-03-21T14:00:00+0200": None,
        "2026-02-30 10:00:00": None,
        "2026-02-30 10:00:00 then 2026-03-01 10:00:00": None,
        "x2026-03-21 12:00:00": None,
        "2026-03-21 12:00:00Z.": "2026-03-21 12:00:00.000000",
        "2026-03-21 24:00:00": None,
        "WARN no timestamp present": None,
    }
    render = lambda c: F.date_format(times.text_event_time(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    assert strings(list(cases), render) == list(cases.values())


def test_json_times(strings):
    cases = {
        '{"ts":"2026-03-21T14:00:00+02:00"}': "2026-03-21 12:00:00.000000",
        '{"ts":"2026-03-21T14:00:00"}': None,
        '{"ts":1711022400}': None,
        '{"ts":"  "}': None,
        '{"ts":"2026-03-21t14:00:00z"}': "2026-03-21 14:00:00.000000",
        '{"ts":"2026-03-21T14:00+02:00"}': "2026-03-21 12:00:00.000000",
        '{"ts":"2026-03-21T24:00:00Z"}': "2026-03-22 00:00:00.000000",
        '{"ts":"2026-03-21T24:00Z"}': None,
        '{"ts":"2026-12-31T23:59:60Z"}': "2026-12-31 23:59:59.000000",
        '{"ts":"2026-03-21T14:00:00.123456789Z"}': "2026-03-21 14:00:00.123456",
        '{"ts":"2026-03-21T14:00:00+0200"}': None,
        '{"@timestamp":"bad","ts":"2026-03-21T14:00:00Z"}': None,
        '{"@timestamp":null,"time":"2026-03-21T14:00:00Z"}': "2026-03-21 14:00:00.000000",
        '{"time":"2026-03-21T14:00:00Z","time":"2026-03-21T15:00:00Z"}': "2026-03-21 15:00:00.000000",
    }
    render = lambda c: F.date_format(
        times.json_event_time(parsing.json_fields(c)), "yyyy-MM-dd HH:mm:ss.SSSSSS"
    )
    assert strings(list(cases), render) == list(cases.values())


def test_json_levels(strings):
    cases = {
        '{"level":"FATAL","severity":"ERROR"}': "ERROR",
        '{"m":"info","n":"error"}': "INFO",
        '{"ERROR":1}': "ERROR",
        '{"level":" warning "}': "WARN",
        '{"x":"MY_ERROR"}': "UNKNOWN",
        '{"a":null,"b":{"k":"x\\nERROR"}}': "ERROR",
        '{"a":"x\\\\nERROR"}': "UNKNOWN",
        '{"a":"info","b":1,"a":"error"}': "ERROR",
        "{}": "UNKNOWN",
    }
    render = lambda c: levels.json_level(parsing.json_fields(c), F.col(c))
    assert strings(list(cases), render) == list(cases.values())


def test_json_candidates_and_strictness(strings):
    assert strings([None, "", " not-json ", ' {"level":"ERROR"} ', "{"], parsing.is_json_candidate) == [
        False, False, False, True, False,
    ]
    cases = {
        '{"a":1}': True,
        ' {"a":[1,2]}\n': True,
        '{"a":1} {"b":2}': False,
        '{"a":1}, {"b":2}': False,
        '{"a":1}] , [{"b":2}': False,
        '{"a":1}} {"b":2}': False,
        '{"a":1}, "y":{"b":2}': False,
        "{'a':1}": False,
        '{"a":NaN}': False,
        "{a:1}": False,
        '\x0b{"a":1}': False,
        "{}": True,
    }
    assert strings(list(cases), lambda c: parsing.json_fields(c).isNotNull()) == list(cases.values())


def test_normalise(strings):
    cases = {
        "2026-03-24 15:00:00 ERROR timeout after 123ms id 3.14 -5": "?-?-? ?:?:? ERROR timeout after 123ms id ?.? -?",
        "2026-03-24T15:00:00Z ERROR timeout": "?-?-24T15:?:00Z ERROR timeout",
        "1.2.3.4.5 1234567890123456 0x1f": "<ip>.? <id> 0x1f",
        "user_42 order-42": "user_42 order-?",
        "id 123e4567-e89b-12d3-a456-426614174000 done": "id <uuid> done",
        "é123": "é?",
        " a \n\t b ": "a b",
        "　": "",
    }
    assert strings(list(cases), identity.normalize_message) == list(cases.values())
    assert strings([None], identity.normalize_message) == [""]
    assert strings(["a 1"], identity.fingerprint_of) == [hashlib.sha256(b"a ?").hexdigest()]


def test_incident_id_is_a_version_five_uuid(spark):
    pairs = [("fp", "c-1"), ("x" * 64, "s"), ("fp", None)]
    frame = spark.createDataFrame(pairs, "f string, s string")
    ours = [row[0] for row in frame.select(identity.incident_id("f", "s")).collect()]
    for (fingerprint, source), value in zip(pairs, ours):
        digest = hashlib.sha1((fingerprint + (source or "null")).encode()).digest()[:16]
        assert value == str(uuid.UUID(bytes=digest, version=5))


def test_windows_and_iso(spark):
    rows = [(datetime(2026, 3, 21, 12, 0, 29),), (datetime(1969, 12, 31, 23, 59, 59),), (None,)]
    frame = spark.createDataFrame(rows, "ts timestamp")
    seconds = [r[0] for r in frame.select(F.unix_seconds(times.window_start("ts", 60))).collect()]
    assert seconds == [1774094400, -60, None]
    stamps = spark.createDataFrame(
        [(datetime(2026, 3, 24, 12, 0, 10),), (datetime(2026, 3, 24, 12, 0, 10, 500000),), (None,)], "ts timestamp"
    )
    assert [r[0] for r in stamps.select(times.iso_utc("ts")).collect()] == [
        "2026-03-24T12:00:10Z", "2026-03-24T12:00:10.5Z", "unknown",
    ]
