"""The late rule as a fold over the windows of a fingerprint, cut where the windows held are known.

Every event adds to the total of its window. If its fingerprint then holds more than three windows,
those more than two before the event's are dropped, and a later event there begins its window again.
Which windows are held depends on all events before, in order of arrival. But only the first event of a
run, consecutive events in one window, can change it, and only fingerprints have to be looked at of
which an event arrives after a window more than two later has begun: the others never begin again. An
expression folds the runs of a fingerprint, as an array.

A fingerprint of more than ``SEGMENT_RUNS`` runs isn't folded in one go. An event in the newest window so
far, when the two windows before it have been seen too, leaves exactly these three: nothing later than
them has arrived that could have dropped them, and whatever else was held is dropped, as there would be
four. The fold starts anew at each such event, so a busy fingerprint, which has events in every window,
falls apart into a segment for every window. Should a segment still have more runs than that, which
takes a fingerprint that never has three windows in a row and yet goes back and forth between windows
that often, it is folded row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.running import Track, dealt, running
from emberline.schemas import RETAINED_WINDOWS
from emberline.session import stage

ORDER = ["seq", "source_id"]
STATE = "fingerprint string, window_start timestamp, window_total bigint"
SEGMENT_RUNS = 20_000
BEFORE = -(2**63)
EVENT = "struct<seq:bigint,source_id:string,second:bigint>"


@dataclass(frozen=True)
class Fold:
    """What the late rule does to some events.

    ``restarts`` (fingerprint, window_start, seq, source_id): events with which a window begins again.
    ``dropped`` (fingerprint, window_start): windows that are not held in the end, if that was asked.
    """

    restarts: DataFrame
    dropped: DataFrame | None = None


def keep_matching(rows: DataFrame, table: DataFrame, names: list[str], how: str) -> DataFrame:
    """A semi or anti join on the named columns of both, where null equals null."""
    other = table.select(*[F.col(name).alias(f"_{name}_") for name in names])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_{name}_")) for name in names])
    return rows.join(other, same, how)


def window_spans(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per fingerprint and window: first and last arrival. Stored windows have arrived before all events."""
    arrival = F.struct(*ORDER)
    second = F.unix_seconds("window_start").alias("_second")
    spans = (
        rows.where(F.col("window_start").isNotNull())
        .groupBy("fingerprint", second)
        .agg(F.min(arrival).alias("_arrived"), F.max(arrival).alias("_last"))
        .withColumn("_first", F.col("_arrived"))
    )
    if stored is not None:
        known = F.struct(F.lit(BEFORE).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("source_id"))
        held = stored.where(F.col("window_start").isNotNull()).select("fingerprint", second, known.alias("_first"), known.alias("_last"))
        spans = (
            spans.unionByName(held, allowMissingColumns=True)
            .groupBy("fingerprint", "_second")
            .agg(F.min("_arrived").alias("_arrived"), F.max("_last").alias("_last"), F.min("_first").alias("_first"))
        )
    return spans


def with_overtaken(spans: DataFrame, width: int) -> DataFrame:
    """Marks windows of which an event arrives after a window more than two later has begun."""
    later = Window.partitionBy("fingerprint").orderBy("_second").rangeBetween(width * RETAINED_WINDOWS + 1, Window.unboundedFollowing)
    return spans.withColumn("_overtaken", F.coalesce(F.min("_first").over(later) < F.col("_last"), F.lit(False)))


def with_cuts(spans: DataFrame, width: int) -> DataFrame:
    """When the fold can be cut at an event of the window.

    From ``_ready`` on, when the window and the two before have begun, up to ``_front_until``, when a
    later one begins.
    """
    by_time = Window.partitionBy("fingerprint").orderBy("_second")
    first = F.min("_first")
    before = [first.over(by_time.rangeBetween(-k * width, -k * width)) for k in range(1, RETAINED_WINDOWS + 1)]
    seen = reduce(lambda a, b: a & b, [one.isNotNull() for one in before])
    return spans.select(
        "*",
        first.over(by_time.rangeBetween(1, Window.unboundedFollowing)).alias("_front_until"),
        F.when(seen, F.greatest("_first", *before)).alias("_ready"),
    )


def _runs(rows: DataFrame, late: DataFrame, slice_width: int) -> DataFrame:
    """The first event of each run of the late fingerprints."""
    narrow = rows.where(F.col("window_start").isNotNull()).select(
        "fingerprint", *ORDER, F.unix_seconds("window_start").alias("_second")
    )
    narrow = keep_matching(narrow, late, ["fingerprint"], "left_semi")
    marked = running(narrow, ["fingerprint"], ORDER, [Track("_prev", "last", F.col("_second"))], slice_width, include_current=False)
    return marked.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_second"))).drop("_prev")


def segments_of(runs: DataFrame, spans: DataFrame, width: int, slice_width: int) -> DataFrame:
    """Runs with the number of their segment; ``_cut`` marks those that begin one, ``_new`` windows that begin."""
    of = with_cuts(spans, width).select(
        F.col("fingerprint").alias("_f"), F.col("_second").alias("_s"), "_first", "_ready", "_front_until"
    )
    here = F.struct(*ORDER)
    joined = runs.join(of, F.col("fingerprint").eqNullSafe(F.col("_f")) & (F.col("_second") == F.col("_s")))
    in_front = F.col("_front_until").isNull() | (here < F.col("_front_until"))
    cut = F.coalesce(here >= F.col("_ready"), F.lit(False)) & in_front
    placed = joined.select("fingerprint", *ORDER, "_second", (here == F.col("_first")).alias("_new"), cut.alias("_cut"))
    return running(placed, ["fingerprint"], ORDER, [Track("_segment", "sum", F.col("_cut").cast("bigint"))], slice_width)


def _fold_arrays(segments: DataFrame, held: DataFrame | None, width: int) -> DataFrame:
    """(fingerprint, _segment, begun, held): the events that begin a window, the windows held in the end."""
    grouped = segments.groupBy("fingerprint", "_segment").agg(
        F.sort_array(F.collect_list(F.struct(*ORDER, F.col("_second").alias("second"), F.col("_new").alias("new"), F.col("_cut").alias("cut")))).alias("runs")
    )
    nothing = F.array().cast("array<bigint>")
    if held is not None:
        start = held.select(F.col("fingerprint").alias("_f"), "_start")
        grouped = grouped.join(start, F.col("fingerprint").eqNullSafe(F.col("_f")) & (F.col("_segment") == 0), "left").drop("_f")
        nothing = F.coalesce("_start", nothing)

    def step(state: Column, run: Column) -> Column:
        known = F.array_contains(state["held"], run["second"])
        grown = F.when(known, state["held"]).otherwise(F.array_append(state["held"], run["second"]))
        oldest = run["second"] - width * RETAINED_WINDOWS
        three = F.array(*[run["second"] - width * k for k in range(RETAINED_WINDOWS, -1, -1)])
        kept = (
            F.when(run["cut"], three)
            .when(F.size(grown) > RETAINED_WINDOWS + 1, F.filter(grown, lambda window: window >= oldest))
            .otherwise(grown)
        )
        event = F.struct(run["seq"], run["source_id"], run["second"]).cast(EVENT)
        begins = F.when(run["cut"], run["new"]).otherwise(~known)
        begun = F.when(begins, F.array_append(state["begun"], event)).otherwise(state["begun"])
        return F.struct(kept.alias("held"), begun.alias("begun"))

    empty = F.struct(nothing.alias("held"), F.array().cast(f"array<{EVENT}>").alias("begun"))
    return grouped.withColumn("_state", F.aggregate("runs", empty, step)).select(
        "fingerprint", "_segment", "_state.begun", "_state.held"
    )


def _fold_rows(segments: DataFrame, held: DataFrame | None, width: int) -> DataFrame:
    """The same for long segments: their runs pass by in order, only the windows held are in memory.

    A row per event that begins a window, then a row with the windows held in the end.
    """
    rows = segments.select("fingerprint", "_segment", *ORDER, "_second", "_new", "_cut")
    if held is not None:
        start = held.select(F.col("fingerprint").alias("_f"), "_start")
        rows = rows.join(start, F.col("fingerprint").eqNullSafe(F.col("_f")) & (F.col("_segment") == 0), "left").drop("_f")
    else:
        rows = rows.withColumn("_start", F.lit(None).cast("array<bigint>"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, windows = None, set()
        for frame in frames:
            out = []
            for fingerprint, segment, seq, source, second, new, cut, start in frame.itertuples(index=False):
                if at != (fingerprint, segment):
                    if at:
                        out.append((*at, None, sorted(windows)))
                    at, windows = (fingerprint, segment), set() if start is None else {int(s) for s in start}
                if new if cut else second not in windows:
                    out.append((*at, [(int(seq), source, int(second))], None))
                windows.add(int(second))
                if cut:
                    windows = {int(second) - width * k for k in range(RETAINED_WINDOWS + 1)}
                elif len(windows) > RETAINED_WINDOWS + 1:
                    windows = {window for window in windows if window >= second - width * RETAINED_WINDOWS}
            yield pd.DataFrame(out, columns=["fingerprint", "_segment", "begun", "held"])
        if at:
            yield pd.DataFrame([(*at, None, sorted(windows))], columns=["fingerprint", "_segment", "begun", "held"])

    ordered = dealt(rows, "fingerprint", "_segment").sortWithinPartitions("fingerprint", "_segment", *ORDER)
    key = rows.schema["fingerprint"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"fingerprint {key}, _segment bigint, begun array<{EVENT}>, held array<bigint>")


def _folded(runs: DataFrame, spans: DataFrame, held: DataFrame | None, width: int, slice_width: int, segment_runs: int) -> DataFrame:
    """``_fold_arrays`` of whole fingerprints, or of the segments of those with very many runs."""
    plain = {"_new": F.lit(False), "_cut": F.lit(False), "_segment": F.lit(0).cast("bigint")}
    many = runs.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") > segment_runs).drop("n")
    if many.isEmpty():
        return _fold_arrays(dealt(runs, "fingerprint").withColumns(plain), held, width)
    many = stage(many, "many")
    few = keep_matching(runs, many, ["fingerprint"], "left_anti").withColumns(plain)
    busy = keep_matching(runs, many, ["fingerprint"], "left_semi")
    segments = stage(segments_of(busy, spans, width, slice_width), "segments")
    which = ["fingerprint", "_segment"]
    long = stage(segments.groupBy(*which).agg(F.count("*").alias("n")).where(F.col("n") > segment_runs).drop("n"), "long")
    short = few.unionByName(keep_matching(segments, long, which, "left_anti"))
    folded = _fold_arrays(dealt(short, *which), held, width)
    if long.isEmpty():
        return folded
    return folded.unionByName(_fold_rows(keep_matching(segments, long, which, "left_semi"), held, width))


def _restarts(folded: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Events that begin a window which had begun, or was stored, before."""
    begun = folded.select("fingerprint", F.explode("begun").alias("e")).select(
        "fingerprint", F.timestamp_seconds("e.second").alias("window_start"), "e.seq", "e.source_id"
    )
    all_begun = begun if stored is None else begun.unionByName(
        stored.select("fingerprint", "window_start", F.lit(BEFORE).cast("bigint").alias("seq")), allowMissingColumns=True
    )
    first = all_begun.groupBy(F.col("fingerprint").alias("_f"), F.col("window_start").alias("_w")).agg(
        F.min(F.struct(*ORDER)).alias("_first"), F.count("*").alias("_n")
    )
    same = F.col("fingerprint").eqNullSafe(F.col("_f")) & (F.col("window_start") == F.col("_w"))
    later = begun.join(first.where(F.col("_n") > 1), same).where(F.struct(*ORDER) > F.col("_first"))
    return later.drop("_f", "_w", "_first", "_n")


def fold_windows(
    rows: DataFrame, window_seconds: int, slice_width: int, stored: DataFrame | None = None, segment_runs: int = SEGMENT_RUNS
) -> Fold | None:
    """The late rule over events with ``window_start``; None if no window begins again and nobody asks what is held.

    With ``stored``, the windows held before, all fingerprints are folded, those without late events over
    the first arrivals of their windows, which have the same effect as their runs.
    """
    width = max(1, window_seconds)
    if stored is None:
        spans = window_spans(rows)
        late = stage(with_overtaken(spans, width).where("_overtaken").select("fingerprint").distinct(), "late")
        if late.isEmpty():
            return None
        runs = stage(_runs(rows, late, slice_width), "runs")
        folded = stage(_folded(runs, spans, None, width, slice_width, segment_runs), "folded")
        restarts = stage(_restarts(folded, None), "restarts")
        return None if restarts.isEmpty() else Fold(restarts)

    whole = Window.partitionBy("fingerprint")
    spans = with_overtaken(window_spans(rows, stored), width)
    spans = stage(
        spans.select("*", F.max("_overtaken").over(whole).alias("_late"), F.count("_arrived").over(whole).alias("_live")), "spans"
    )
    arrived = spans.where(~F.col("_late") & F.col("_arrived").isNotNull())
    runs = arrived.select("fingerprint", "_arrived.seq", "_arrived.source_id", "_second")
    late = spans.where("_late").select("fingerprint").distinct()
    if not late.isEmpty():
        runs = stage(runs.unionByName(_runs(rows, late, slice_width)), "runs")
    held = (
        stored.where(F.col("window_start").isNotNull())
        .groupBy("fingerprint")
        .agg(F.collect_set(F.unix_seconds("window_start")).alias("_start"))
    )
    folded = stage(_folded(runs, spans, held, width, slice_width, segment_runs), "folded")
    restarts = stage(_restarts(folded, stored), "restarts")
    last = folded.where(F.col("held").isNotNull()).groupBy("fingerprint").agg(F.max_by("held", "_segment").alias("held"))
    left = last.select("fingerprint", F.explode("held").alias("_second"))
    gone = keep_matching(spans.where(F.col("_live") > 0), left, ["fingerprint", "_second"], "left_anti")
    return Fold(restarts, gone.select("fingerprint", F.timestamp_seconds("_second").alias("window_start")))
