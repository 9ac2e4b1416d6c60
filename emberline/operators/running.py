"""Running values per key that never put one key's rows into one task.

A plain window over a key sorts all rows of that key in one task, which fails when one key holds a
large share of the data. Here every key is cut into slices of its order column, values are folded
inside each slice, and a small per-slice summary carries the state of earlier slices forward as one
extra seed row in front of the slice. With a unique order column a slice holds at most
``slice_width`` rows, and a key has at most (order range / slice_width) summary rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SLICE_WIDTH = 1_000_000


@dataclass(frozen=True)
class Track:
    """One running value: ``how`` is sum, last or first; nulls do not contribute."""

    name: str
    how: str
    value: Column


def slice_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width)}")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key over as many tasks as are set, however few bytes they are.

    For steps with much work a row: by bytes alone they get about one task a core, and then wait for the longest.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _summarise(track: Track, order: list[str]) -> Column:
    value = F.col(track.name)
    if track.how == "sum":
        return F.sum(value).alias(track.name)
    pick = F.max_by if track.how == "last" else F.min_by
    return pick(value, F.when(value.isNotNull(), F.struct(*order))).alias(track.name)


def _over(track: Track, window) -> Column:
    value = F.col(track.name)
    if track.how == "sum":
        return F.coalesce(F.sum(value).over(window), F.lit(0).cast("bigint")).alias(track.name)
    pick = F.last if track.how == "last" else F.first
    return pick(value, ignorenulls=True).over(window).alias(track.name)


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    tracks: list[Track],
    slice_width: int = DEFAULT_SLICE_WIDTH,
    include_current: bool = True,
    slice_name: str | None = None,
) -> DataFrame:
    """``rows`` plus one column per track, folded over the rows of the same keys up to this one.

    ``order[0]`` must be a bigint that rises with arrival; the other columns break ties. Null keys
    form a group of their own. ``slice_name`` keeps the slice number for later use.
    """
    cut = slice_name or "_slice"
    kept = rows.columns
    group = [*keys, cut]
    marked = rows.select(
        "*",
        slice_of(order[0], slice_width).alias(cut),
        *[track.value.alias(track.name) for track in tracks],
    )

    before = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        marked.groupBy(*group)
        .agg(*[_summarise(track, order) for track in tracks])
        .select(*group, *[_over(track, before) for track in tracks])
    )
    carried = [
        F.col(track.name) != 0 if track.how == "sum" else F.col(track.name).isNotNull()
        for track in tracks
    ]
    seeds = seeds.where(reduce(lambda left, right: left | right, carried))

    frame_end = Window.currentRow if include_current else -1
    upto = (
        Window.partitionBy(*group)
        .orderBy(F.col("_seed").desc(), *order)
        .rowsBetween(Window.unboundedPreceding, frame_end)
    )
    both = marked.withColumn("_seed", F.lit(False)).unionByName(
        seeds.withColumn("_seed", F.lit(True)), allowMissingColumns=True
    )
    result = both.select(
        *kept, "_seed", *([cut] if slice_name else []), *[_over(track, upto) for track in tracks]
    )
    return result.where(~F.col("_seed")).drop("_seed")
