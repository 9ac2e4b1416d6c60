"""Counts per fingerprint and tumbling window, and the anomalies they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import column
from emberline.functions.times import event_or_ingest_time, window_start
from emberline.operators.lateness import BEFORE, ORDER, Fold, fold_windows, keep_matching
from emberline.operators.running import DEFAULT_SLICE_WIDTH, Track, running, slice_of
from emberline.schemas import ALERT_THRESHOLD, WINDOW_SECONDS
from emberline.session import stage

GROUP = ["fingerprint", "window_start"]


def with_window(events: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    return events.withColumn("window_start", window_start(event_or_ingest_time(), window_seconds))


def window_counts(events: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Total per fingerprint and window, over all sources and levels."""
    return (
        with_window(events, window_seconds)
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("window_total"))
    )


def restarted(rows: DataFrame, restarts: DataFrame, slice_width: int = DEFAULT_SLICE_WIDTH) -> DataFrame:
    """Rows with ``_epoch``: how often their window had begun again when they arrived.

    The restarts pass by as rows of their own in front of the events that they are.
    """
    marks = restarts.withColumn("_mark", F.lit(0))
    both = rows.withColumn("_mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    track = Track("_epoch", "sum", (F.col("_mark") == 0).cast("bigint"))
    return running(both, GROUP, [*ORDER, "_mark"], [track], slice_width).where(F.col("_mark") == 1).drop("_mark")


def _plain_and_restarted(rows: DataFrame, fold: Fold | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of windows that begin once, rows of the others)."""
    if fold is None:
        return rows, None
    again = fold.restarts.select(*GROUP).distinct()
    return keep_matching(rows, again, GROUP, "left_anti"), keep_matching(rows, again, GROUP, "left_semi")


def one() -> Column:
    return F.lit(1).cast("bigint")


def with_running_count(
    events: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    slice_width: int = DEFAULT_SLICE_WIDTH,
) -> DataFrame:
    """Adds ``window_count``: how many events of the group arrived up to and including this one.

    A window that the late rule has dropped counts from one again (``lateness``). Events without any
    time form a group of their own.
    """
    rows = with_window(events, window_seconds)
    fold = fold_windows(rows, window_seconds, slice_width)
    plain, again = _plain_and_restarted(rows, fold)
    counted = running(plain, GROUP, ORDER, [Track("window_count", "sum", one())], slice_width)
    return counted if again is None else counted.unionByName(_count_restarted(again, fold, slice_width))


def _count_restarted(rows: DataFrame, fold: Fold, slice_width: int) -> DataFrame:
    epochs = restarted(rows, fold.restarts, slice_width)
    return running(epochs, [*GROUP, "_epoch"], ORDER, [Track("window_count", "sum", one())], slice_width).drop("_epoch")


def count_onto(
    rows: DataFrame, stored: DataFrame, window_seconds: int, slice_width: int = DEFAULT_SLICE_WIDTH
) -> tuple[DataFrame, Fold]:
    """(events with ``window_count``, what the late rule did), going on from the windows ``stored``.

    A stored total passes by as a row in front of the events of its window.
    """
    fold = fold_windows(rows, window_seconds, slice_width, stored)
    first = stored.select("fingerprint", "window_start", F.lit(BEFORE).cast("bigint").alias("seq"), F.col("window_total").alias("_n"))
    both = rows.withColumn("_n", one()).unionByName(first.withColumn("_given", F.lit(True)), allowMissingColumns=True)
    plain, again = _plain_and_restarted(both, None if fold.restarts.isEmpty() else fold)
    total = [Track("window_count", "sum", F.col("_n"))]
    counted = running(plain, GROUP, ORDER, total, slice_width)
    if again is not None:
        epochs = restarted(again, fold.restarts, slice_width)
        counted = counted.unionByName(running(epochs, [*GROUP, "_epoch"], ORDER, total, slice_width).drop("_epoch"))
    return counted.where(F.col("_given").isNull()).drop("_n", "_given"), fold


def held_after(counted: DataFrame, stored: DataFrame, fold: Fold) -> DataFrame:
    """The windows held after the events counted, with their totals."""
    totals = counted.select(*GROUP, F.struct(*ORDER).alias("_at"), "window_count").unionByName(
        stored.select(*GROUP, F.col("window_total").alias("window_count")), allowMissingColumns=True
    )
    # stored totals have no arrival, which is before any
    last = totals.groupBy(*GROUP).agg(F.max(F.struct("_at", "window_count")).alias("_end"))
    held = last.select(*GROUP, F.col("_end.window_count").alias("window_total"))
    return keep_matching(held, fold.dropped, GROUP, "left_anti")


def _count_above(events: DataFrame, threshold: int, slice_width: int) -> DataFrame:
    """Running counts for the slices in which an ERROR can still exceed the threshold.

    Slice totals are a partially aggregated group-by; the rows are shuffled once, by
    (fingerprint, window, slice), for both the join and the ranking.
    """
    cut = events.withColumn("_slice", slice_of("seq", slice_width))
    earlier = Window.partitionBy(*GROUP).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*GROUP, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("level") == "ERROR").alias("_errors"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where((F.col("_before") + F.col("_rows") > threshold) & (F.col("_errors") > 0))
        .select(*GROUP, "_slice", "_before")
    )
    inside = Window.partitionBy(*GROUP, "_slice").orderBy("seq", "source_id")
    kept = totals.select(
        F.col("fingerprint").alias("_f"), F.col("window_start").alias("_w"), F.col("_slice").alias("_s"), "_before"
    )
    same = (
        F.col("fingerprint").eqNullSafe(F.col("_f"))
        & F.col("window_start").eqNullSafe(F.col("_w"))
        & (F.col("_slice") == F.col("_s"))
    )
    return (
        cut.join(kept, same)
        .withColumn("window_count", F.col("_before") + F.row_number().over(inside))
        .drop("_slice", "_before", "_f", "_w", "_s")
    )


def is_anomaly(level: Column | str, count: Column | str, threshold: int = ALERT_THRESHOLD) -> Column:
    return (column(level) == "ERROR") & (column(count) > threshold)


def anomaly_columns(detected_at: Column | str = "ingest_time") -> list[Column]:
    return [
        F.col("fingerprint"),
        F.col("level"),
        F.col("source_id"),
        F.col("source_name"),
        column(detected_at).alias("detected_at"),
        F.col("window_count").alias("count"),
        F.col("message").alias("sample_message"),
        F.col("seq"),
    ]


def detect_anomalies(
    events: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    threshold: int = ALERT_THRESHOLD,
    detected_at: Column | str = "ingest_time",
    slice_width: int = DEFAULT_SLICE_WIDTH,
) -> DataFrame:
    """One anomaly per ERROR event whose running count is above the threshold.

    Every level is counted; the level filter applies to the counted events only. The late rule and the
    counts look at one fingerprint at a time, so those without an ERROR event are left out before both.
    """
    # stored, so that its size is known and few fingerprints need no shuffle of the events
    failing = stage(events.where(F.col("level") == "ERROR").select("fingerprint").distinct(), "failing")
    rows = with_window(stage(keep_matching(events, failing, ["fingerprint"], "left_semi"), "candidates"), window_seconds)
    fold = fold_windows(rows, window_seconds, slice_width)
    plain, again = _plain_and_restarted(rows, fold)
    counted = _count_above(plain, threshold, slice_width)
    if again is not None:
        counted = counted.unionByName(_count_restarted(again, fold, slice_width))
    return counted.where(is_anomaly("level", "window_count", threshold)).select(
        *anomaly_columns(detected_at)
    )


def anomalies_of_counted(
    counted: DataFrame, threshold: int = ALERT_THRESHOLD, detected_at: Column | str = "ingest_time"
) -> DataFrame:
    """The same predicate over events that already carry ``window_count``."""
    return counted.where(is_anomaly("level", "window_count", threshold)).select(
        *anomaly_columns(detected_at)
    )
