from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberline.operators import dashboard as D
from emberline.operators.dashboard import View
from emberline.operators.notifications import NotificationSettings, build_notifications
from emberline.operators.summaries import (
    map_summary,
    render_prompt,
    resolve_summary,
    summary_requests,
    usable_summary,
)
from emberline.schemas import JOBS, SOURCES, SUMMARY

T0 = datetime(2026, 3, 24, 12, 0, tzinfo=timezone.utc)
CARD = (
    "id string, title string, source_name string, source_id string, severity string, status string, "
    "last_seen_at timestamp, summary string"
)


@pytest.fixture
def cards(spark):
    return spark.createDataFrame(
        [
            ("i1", "Timeout", "api", "c-1", "LOW", "REGRESSED", T0, "boom"),
            ("i2", "Crash", "web", "c-2", "HIGH", "CLOSED", T0, "down"),
            ("i3", "Slow", None, "c-9", None, "OPEN", None, "late TIMEOUT"),
            ("i4", "Crash", "named", "zz", "HIGH", "OPEN", T0.replace(hour=13), "x"),
        ],
        CARD,
    )


@pytest.fixture
def sources(spark):
    return spark.createDataFrame(
        [("docker", "c-1", "api", "Up"), ("docker", "c-2", "named", "Up"), ("k8s", "c-9", "pod", "idle?")], SOURCES
    )


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame(
        [
            (1, "docker", "tail-all", ["c-1", "c-7"], [False, True], T0),
            (2, "k8s", "tail-one", ["c-1"], [True], T0),
            (3, "k8s", "tail-one", ["c-5"], [False], T0.replace(hour=14)),
        ],
        JOBS,
    )


def ids(frame):
    return [row.id for row in frame.collect()]


def test_ranking(cards):
    ranked = sorted(D.rank_incidents(cards).collect(), key=lambda row: row.position)
    assert [(r.id, r.priority_score, r.position) for r in ranked] == [("i4", 34, 1), ("i2", 30, 2), ("i1", 15, 3), ("i3", 4, 4)]
    assert ids(D.rank_incidents(cards, -1)) == [] and sorted(ids(D.rank_incidents(cards, 2))) == ["i2", "i4"]


def test_ranking_keeps_every_card(spark):
    many = spark.range(40).select(
        F.format_string("i%02d", "id").alias("id"), F.lit("LOW").alias("severity"), F.lit("OPEN").alias("status"),
        F.timestamp_seconds("id").alias("last_seen_at"),
    )
    ranked = {row.id: row.position for row in D.rank_incidents(many.repartition(7)).collect()}
    assert ranked == {f"i{n:02d}": 40 - n for n in range(40)}


def test_filters(cards, sources):
    assert set(ids(D.filter_incidents(cards, View(search="TimeOut")))) == {"i1", "i3"}
    assert ids(D.filter_incidents(cards, View(severity="HIGH", status="OPEN"))) == ["i4"]
    # i4 belongs by name, i1 by id and name; it must appear once.
    assert sorted(ids(D.filter_incidents(cards, View(runtime="docker"), sources))) == ["i1", "i2", "i4"]
    assert ids(D.filter_incidents(cards, View(runtime="none"), sources)) == []


def test_sources_and_runtimes(sources, jobs):
    assert sorted(ids(D.select_available_sources(sources, jobs))) == ["c-2", "c-9"]
    views = D.source_views(sources, jobs)
    assert {(r.id, r.active) for r in views.collect()} == {("c-1", True), ("c-2", False), ("c-9", False)}
    summary = {r.runtime_key: (r.running_sources, r.active_sources, r.idle_sources) for r in D.runtime_summary(views).collect()}
    assert summary == {"docker": (2, 1, 1), "k8s": (1, 0, 1)}
    assert ids(D.filter_sources(views, View(search="TAILING"))) == ["c-1"]
    # The idle flag and a status text that holds the same word both match.
    assert sorted(ids(D.filter_sources(views, View(search="idle")))) == ["c-2", "c-9"]
    kept = D.filter_runtimes(D.runtime_summary(views), views, View(search="k8")).collect()
    assert [(r.runtime_key, r.listed_sources) for r in kept] == [("k8s", 1)]
    assert sorted(ids(D.page_sources(views, 1))) == ["c-1", "c-9"]
    panel = {r.runtime_key: r.sources for r in D.runtime_panels(views, 1).collect()}
    assert [s.id for s in panel["docker"]] == ["c-1"]


def test_runtime_without_sources(spark, sources, jobs):
    runtimes = spark.createDataFrame([("docker",), ("empty",), ("k8s",)], "runtime_key string")
    views = D.source_views(sources, jobs)
    found = {r.runtime_key: r.running_sources for r in D.runtime_summary(views, runtimes).collect()}
    assert found == {"docker": 2, "empty": 0, "k8s": 1}


def test_jobs(jobs):
    assert {r.id: (r.status, r.source_count) for r in D.job_views(jobs).collect()} == {
        1: ("running", 2), 2: ("stopped", 1), 3: ("running", 1),
    }
    assert ids(D.list_jobs(jobs)) == [3, 1]
    assert ids(D.filter_jobs(jobs, View(search="C-7"))) == [1]
    assert ids(D.filter_jobs(jobs, View(search="tail", runtime="k8s"))) == [3]


def test_list_sources_defaults(spark):
    raw = spark.createDataFrame(
        [(" Docker", "a", ["n1", "n2"], "Up"), ("docker", " ", [], None), (" ", "x", None, None)],
        "runtime_key string, id string, names array<string>, status string",
    )
    found = {tuple(r) for r in D.list_sources(raw).collect()}
    assert found == {("docker", "a", "n1", "Up"), ("docker", "unknown", "unknown", "unknown")}


def test_metrics_and_insights(cards, sources, jobs):
    views = D.source_views(sources, jobs)
    runtimes = D.runtime_summary(views)
    metrics = D.overview_metrics(runtimes, jobs, cards)
    assert tuple(metrics.first()) == (2, 2, 2, 4)
    view = View(search="docker")
    kept = D.filter_runtimes(runtimes, views, view)
    tiles = D.filtered_metrics(metrics, kept, D.filter_jobs(jobs, view), D.filter_incidents(cards, view), view)
    assert [tuple(r) for r in tiles.collect()] == [
        ("connected_runtimes", 2, 1, True), ("active_jobs", 2, 1, True),
        ("open_incidents", 2, 0, True), ("visible_incidents", 0, 0, True),
    ]
    found = D.dashboard_insights(kept, cards).first()
    assert tuple(found) == ("docker", 1, 2, 1, 2, "Crash", "named", 2)
    empty = D.dashboard_insights(kept.limit(0), cards.limit(0)).first()
    assert (empty.busiest_runtime, empty.running_sources, empty.urgent_title, empty.high_incidents) == (None, 0, None, 0)
    chips = {r.key: r["count"] for r in D.runtime_filter_counts(runtimes, kept).collect()}
    assert chips == {"all": 1, "docker": 1, "k8s": 0}


def test_overlay(cards):
    updated = cards.where("id = 'i2'").withColumn("status", F.lit("OPEN"))
    assert {r.id: r.status for r in D.overlay_incidents(cards, updated).collect()} == {
        "i1": "REGRESSED", "i2": "OPEN", "i3": "OPEN", "i4": "OPEN",
    }


def test_counts_follow_an_overlay(cards):
    updated = cards.where("id = 'i2'").withColumn("status", F.lit("OPEN"))
    assert tuple(D.card_metrics(cards).first()) == (2, 4)
    assert tuple(D.card_metrics(D.overlay_incidents(cards, updated)).first()) == (3, 4)


def test_search_covers_every_sample(spark):
    """1500 samples of one incident; a text is found in any of them, and across two of them."""
    schema = (
        "id string, fingerprint string, source_id string, source_name string, severity string, status string, "
        "last_seen_at timestamp, sample_message string"
    )
    rows = [("i1", "f", "s", "web", "HIGH", "OPEN", T0, None), ("i2", "g", "t", None, None, None, T0, " "), ("i3", "h", "u", "api", "LOW", "CLOSED", T0, "own")]
    incidents = spark.createDataFrame(rows, schema)
    samples = spark.range(1, 1501).select(
        F.lit("f").alias("fingerprint"), F.lit("s").alias("source_id"),
        F.format_string("sample <%d>", "id").alias("sample"), F.col("id").alias("position"),
    )

    def found(search, **more):
        return sorted(ids(D.find_incidents(incidents, samples, View(search=search, **more))))

    assert found("Sample <1400>") == ["i1"] and found("<999>") == ["i1"] and found("<1501>") == []
    assert found("<1400>\nsample <1401>") == ["i1"]
    assert found("OWN") == ["i2", "i3"] and found("no sample") == ["i2"] and found("container inc") == ["i2"]
    assert found("<3>", severity="LOW") == [] and found("", status="OPEN") == ["i1", "i2"] and found("t") == ["i2"]
    card = D.find_incidents(incidents, samples, View(search="<1400>")).first()
    assert card.summary.count("\n") == 1499
    for search in ("Sample <1400>", "OWN", "web", "open", "unknown", "u", "no sample", ""):
        every = D.incident_cards(D.nest_samples(incidents, samples))
        assert found(search) == sorted(ids(D.filter_incidents(every, View(search=search)))), search


def test_cards_from_incidents(spark):
    rows = [
        ("i1", "f", "s", None, None, None, T0, "x" * 130),
        ("i2", "g", "s", " ", "HIGH", "CLOSED", T0, "  "),
        ("i3", "h", "s", "web", "HIGH", "OPEN", T0, None),
    ]
    incidents = spark.createDataFrame(
        rows,
        "id string, fingerprint string, source_id string, source_name string, severity string, status string, "
        "last_seen_at timestamp, sample_message string",
    )
    samples = spark.createDataFrame(
        [("h", "s", f"sample {n}", n) for n in range(1, 6)],
        "fingerprint string, source_id string, sample string, position bigint",
    )
    nested = D.nest_samples(incidents, samples)
    found = {r.id: r for r in D.incident_cards(nested).collect()}
    assert found["i1"].title == "x" * 117 + "..." and found["i1"].source_name == "s"
    assert (found["i1"].severity, found["i1"].status) == ("UNKNOWN", "OPEN")
    assert (found["i2"].title, found["i2"].summary) == ("Container incident", "No sample logs available")
    assert (found["i3"].title, found["i3"].summary) == ("sample 1", "\n".join(f"sample {n}" for n in range(1, 6)))
    assert {r.id: r.sample_count for r in nested.collect()} == {"i1": 1, "i2": 0, "i3": 5}
    assert len(ids(D.recent_incidents(incidents, 2))) == 2 and ids(D.recent_incidents(incidents, -1)) == []


def anomaly(spark, **changes):
    values = dict(fingerprint="fp", level="ERROR", source_id="c-1", source_name="payments-api", detected_at=T0,
                  count=57, sample_message="<boom>", seq=1, summary=("Title", "What\nhappened", "Cause", "Do", "HIGH"))
    values.update(changes)
    schema = ("fingerprint string, level string, source_id string, source_name string, detected_at timestamp, "
              f"count bigint, sample_message string, seq bigint, summary {SUMMARY}")
    return spark.createDataFrame([tuple(values.values())], schema)


def test_notification(spark):
    settings = NotificationSettings(to="a@x.org, b@x.org", subject_prefix="[Alerts]")
    mail = build_notifications(anomaly(spark), settings).first()
    assert mail.recipients == ["a@x.org", "b@x.org"]
    assert mail.subject == "[Alerts] [HIGH] ERROR anomaly in payments-api"
    for text in ("- Title: Title", "What\nhappened", "- Fingerprint: fp", "<boom>", "- Detected at (UTC): 2026-03-24T12:00:00Z"):
        assert text in mail.text_body
    assert "What<br/>happened" in mail.html_body and "&lt;boom&gt;" in mail.html_body
    plain = build_notifications(anomaly(spark, source_name=None, summary=(None, "{title}", None, None, None)),
                                NotificationSettings(to="a@x.org")).first()
    assert plain.subject == "[Incident Watch] [UNKNOWN] ERROR anomaly in unknown"
    assert "- Title: unknown" in plain.text_body and "What happened\n{title}\n" in plain.text_body
    assert build_notifications(anomaly(spark), NotificationSettings(to=" , ")).count() == 0
    assert build_notifications(anomaly(spark), NotificationSettings(enabled=False, to="a@x.org")).count() == 0


def test_prompt(spark):
    found = anomaly(spark, source_name=None, sample_message="see {level}")
    prompt = summary_requests(found).select(render_prompt("{fingerprint}|{level}|{count}|{sourceId}|{sourceName}|{samples}")).first()[0]
    assert prompt == "fp|ERROR|57|c-1|unknown|1. see {level}\n"
    none = summary_requests(anomaly(spark, sample_message=None)).select(render_prompt("{samples}")).first()[0]
    assert none == "No sample logs available"


def test_summaries(spark):
    frame = spark.createDataFrame([(0, "text", None), (1, " ", None), (2, None, "IOException")], "n int, response string, error string")
    found = frame.select("n", map_summary("response", "error").alias("s")).orderBy("n").collect()
    assert [r.s.title for r in found] == ["AI Incident Analysis", "AI Incident Analysis", "AI Incident Analysis Failed"]
    assert [r.s.summary for r in found] == ["text", "No response content returned by model", "The AI model call failed"]
    assert found[2].s.probable_cause == "IOException"
    no_model = frame.select(usable_summary(map_summary("response", model_configured=False)).alias("s"))
    assert [r.s for r in no_model.collect()] == [None] * 3
    old = F.struct(*[F.lit(v).alias(n) for n, v in zip(("title", "summary", "probable_cause", "suggested_actions", "severity"), "abcde")])
    kept = frame.select(resolve_summary(map_summary("response", model_configured=False), old).alias("s")).first().s
    assert kept.title == "a"
