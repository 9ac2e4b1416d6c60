"""The late rule: cut into segments, folded by expressions or row by row, in batch and from stored windows."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import lateness
from emberline.operators.counting import count_onto, detect_anomalies, held_after, with_running_count, with_window
from emberline.operators.lateness import STATE, fold_windows
from tests.test_counting import counts, make_events, one_by_one
from tests.test_plans import assert_scalable, plan_of


def shuffled_arrivals(number, seed, steps, late, keys="abbbbbb", width=60):
    """Events whose times go forward by ``steps`` seconds, some of them late by a number of windows."""
    pick, now, rows = random.Random(seed), 0, []
    for seq in range(number):
        now += pick.choice(steps)
        at = max(0, now - pick.choice(late) * width)
        rows.append((pick.choice(keys), "s", pick.choice(["ERROR", "INFO"]), at, seq))
    return rows


# a few of the ways in which windows are mixed; sizes are small, since every fold takes several jobs
CASES = {
    "busy, a bit late": ([3, 10, 20], [0, 0, 0, 0, 1, 2, 3, 5]),
    "far apart": ([0, 0, 400, 1000], [0, 0, 0, 7, 20]),
    "hours with their borders mixed": ([0, 0, 0, 0, 0, 3600], [0, 0, 60, 60, 120]),
    "anywhere": ([0, 1], list(range(0, 9))),
    "backwards": ([-70, 0, 130], [0, 0, 1]),
}


@pytest.mark.parametrize("case", CASES)
def test_counts_equal_one_by_one(spark, case, monkeypatch):
    steps, late = CASES[case]
    rows = shuffled_arrivals(500, 5, steps, late)
    expected, events = one_by_one(rows), make_events(spark, rows).cache()
    assert counts(with_running_count(events, 60, 90)) == expected
    found = {(r.seq, r["count"]) for r in detect_anomalies(events, 60, 4, slice_width=50).collect()}
    assert found == {(seq, expected[seq]) for _, _, level, _, seq in rows if level == "ERROR" and expected[seq] > 4}


def folded(events, stored=None, segment_runs=lateness.SEGMENT_RUNS):
    made = fold_windows(with_window(events, 60), 60, 100, stored, segment_runs)
    restarts = sorted((r.fingerprint, r.seq) for r in made.restarts.collect())
    return restarts, None if made.dropped is None else sorted((r.fingerprint, r.window_start) for r in made.dropped.collect())


@pytest.mark.parametrize("case", ["busy, a bit late", "hours with their borders mixed"])
def test_long_segments_fold_like_short_ones(spark, case):
    rows = shuffled_arrivals(400, 6, *CASES[case])
    events = make_events(spark, rows).cache()
    none = spark.createDataFrame([], STATE)
    whole = folded(events, none)
    assert folded(events, none, segment_runs=30) == whole and folded(events, none, segment_runs=3) == whole


@pytest.mark.parametrize("case", ["busy, a bit late", "far apart", "backwards"])
def test_any_cut_into_batches_counts_alike(spark, case):
    rows = shuffled_arrivals(160, 7, *CASES[case])
    expected, pick = one_by_one(rows), random.Random(1)
    cuts = [0, *sorted(pick.sample(range(1, 160), 2)), 160]
    state, found = spark.createDataFrame([], STATE), {}
    for low, high in zip(cuts, cuts[1:]):
        events = with_window(make_events(spark, rows[low:high]), 60)
        counted, fold = count_onto(events, state, 60)
        found |= counts(counted)
        state = spark.createDataFrame(held_after(counted, state, fold).collect(), STATE)
    assert found == expected


def test_a_busy_fingerprint_is_folded_in_many_parts(spark):
    """One key, late events throughout: no part of the fold sees more than the runs of a few windows."""
    rows = shuffled_arrivals(3_000, 8, [0, 3], [0, 0, 0, 0, 1, 2, 4], keys="a")
    events = with_window(make_events(spark, rows), 60)
    runs = lateness._runs(events, events.select("fingerprint").distinct(), 200)
    segments = lateness.segments_of(runs, lateness.window_spans(events), 60, 200)
    sizes = [r["count"] for r in segments.groupBy("_segment").count().collect()]
    assert sum(sizes) > 1_000 and max(sizes) < 40


def test_late_events_need_no_python_and_no_task_per_key(spark):
    rows = shuffled_arrivals(300, 9, [0, 5, 20], [0, 0, 0, 4], keys="a")
    events = make_events(spark, rows)
    late = with_running_count(events, 60, 50)
    assert "_epoch" in late._jdf.queryExecution().analyzed().toString()
    assert_scalable(plan_of(late))
    segments = spark.createDataFrame(
        [("a", 0, 1, "s", 0, False, False)], "fingerprint string, _segment bigint, seq bigint, source_id string, _second bigint, _new boolean, _cut boolean"
    )
    assert_scalable(plan_of(lateness._fold_arrays(segments, None, 60)))


def test_events_in_order_take_the_plain_plan(spark):
    rows = [("a", "s", "INFO", n * 7, n) for n in range(50)] + [("b", "s", "INFO", n, 100 + n) for n in range(50)]
    plain = with_running_count(make_events(spark, rows), 60)
    assert "_epoch" not in plain._jdf.queryExecution().analyzed().toString()
    assert counts(plain) == one_by_one(rows)


def test_events_without_time_and_null_keys(spark):
    rows = shuffled_arrivals(120, 11, [20, 40], [0, 0, 5], keys=["a", None])
    events = make_events(spark, rows)
    timeless = events.withColumn("ingest_time", F.when(F.col("seq") % 10 == 0, F.lit(None)).otherwise(F.col("ingest_time")))
    timeless = timeless.withColumn("event_time", F.when(F.col("seq") % 10 != 0, F.col("event_time")))
    expected = one_by_one([(fp, s, lv, None if seq % 10 == 0 else at, seq) for fp, s, lv, at, seq in rows])
    assert counts(with_running_count(timeless, 60, 30)) == expected
