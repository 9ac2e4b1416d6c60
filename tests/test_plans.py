"""What the physical plans must look like, whatever the data size."""

from pyspark.sql import functions as F

from emberline.operators.counting import detect_anomalies, with_running_count
from emberline.operators.dashboard import View, filter_incidents, page_sources
from emberline.operators.entries import log_entries
from emberline.operators.incidents import fold_incidents
from emberline.operators.parsing import log_events
from tests.test_counting import make_events
from tests.test_dashboard import CARD
from tests.test_entries import make_lines
from tests.test_incidents import make_anomalies, make_commands


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def assert_scalable(plan):
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        assert bad not in plan, bad


def windows(plan):
    return [line for line in plan.splitlines() if "Window [" in line]


def test_entries_window_by_source_and_slice(spark):
    plan = plan_of(log_events(log_entries(make_lines(spark, [("s", 1, "a", 0)]))))
    assert_scalable(plan)
    # Lines are only ever windowed inside a slice; whole-source windows see slice summaries.
    assert sum("line#" in line and "_slice" not in line for line in windows(plan)) == 0
    assert plan.count("Exchange hashpartitioning(source_id") <= 4


def test_counting_shuffles_rows_once(spark):
    events = make_events(spark, [("fp", "a", "ERROR", 0, 1)])
    for frame in (with_running_count(events), detect_anomalies(events)):
        plan = plan_of(frame)
        assert_scalable(plan)
        assert "partial_" in plan


def test_level_filter_stays_above_the_count(spark):
    plan = plan_of(with_running_count(make_events(spark, [("fp", "a", "ERROR", 0, 1)])).where("level = 'ERROR'"))
    assert plan.index("ERROR") < plan.index("Window")


def test_fold_is_windowed_by_slice(spark):
    fold = fold_incidents(
        make_anomalies(spark, [("f", "s", 1, 0, "m", None)]), make_commands(spark, [("f", "s", "CLOSED", 1)])
    )
    for frame in (fold.incidents, fold.events, fold.rejected):
        assert_scalable(plan_of(frame))


def test_runtime_filter_uses_equality_joins(spark):
    cards = spark.createDataFrame([], CARD)
    sources = spark.createDataFrame([], "runtime_key string, id string, name string, status string")
    assert_scalable(plan_of(filter_incidents(cards, View(runtime="docker"), sources)))


def test_page_is_limited_before_the_shuffle(spark, tmp_path):
    spark.range(100).select(
        F.lit("r").alias("runtime_key"), F.col("id").cast("string").alias("id"), F.lit(True).alias("active")
    ).write.parquet(str(tmp_path / "v"))
    plan = plan_of(page_sources(spark.read.parquet(str(tmp_path / "v"))))
    assert plan.count("WindowGroupLimit") == 2
