"""Multi-line entries: which lines belong together, and their assembly into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import BLANK, column
from emberline.operators.running import DEFAULT_SLICE_WIDTH, dealt, slice_of
from emberline.schemas import IDLE_FLUSH_MS, MAX_ENTRY_LINES

# Beginnings that mark a continuation line.
CONTINUATION = r"^(?:[ \t]|at |Caused by:|\.\.\.)"


def is_entry_start(line: Column | str) -> Column:
    """Null and empty lines open an entry; blank, indented and stack-trace lines continue one."""
    line = column(line)
    continues = line.rlike(BLANK) | line.rlike(CONTINUATION)
    return F.coalesce((line == "") | ~continues, F.lit(True))


def segment_entries(
    lines: DataFrame,
    max_lines: int = MAX_ENTRY_LINES,
    idle_ms: int | None = IDLE_FLUSH_MS,
    slice_width: int = DEFAULT_SLICE_WIDTH,
) -> DataFrame:
    """Adds ``entry_key`` (seq of the opening line) and ``chunk`` (part number of a long entry).

    An entry closes before a start line, after ``max_lines`` lines, and after a pause of at least
    ``idle_ms``; ``None`` turns the pause rule off. Work is split by (source, slice of seq), so one
    busy source spreads over many tasks; only (line count, open entry) travels between slices.
    """
    part = ["source_id", "_slice"]
    pause = F.unix_micros("received_at") - F.unix_micros("_previous") >= F.lit((idle_ms or 0) * 1000)
    pauses = F.lit(False) if idle_ms is None else F.coalesce(pause, F.lit(False))
    cut = lines.select("*", slice_of("seq", slice_width).alias("_slice"), is_entry_start("line").alias("_header"))

    # Light pass: what each slice holds, seen on its own. Its first line has no predecessor here.
    inside = Window.partitionBy(*part).orderBy("seq")
    light = (
        cut.select(*part, "seq", "received_at", "_header")
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn("_previous", F.lag("received_at").over(inside))
        .withColumn("_opens", F.col("_header") | pauses)
    )
    per_slice = light.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.max(F.when(F.col("_opens"), F.col("seq"))).alias("_open_key"),
        F.max(F.when(F.col("_opens"), F.col("_rank"))).alias("_open_rank"),
        F.min("seq").alias("_first_seq"),
        F.min_by("received_at", "seq").alias("received_at"),
        F.max_by("received_at", "seq").alias("_last_time"),
    )
    # Over slices only: a pause before the slice, lines seen before it, the entry still open there.
    by_slice = Window.partitionBy("source_id").orderBy("_slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        per_slice.withColumn("_previous", F.lag("_last_time").over(by_slice))
        .withColumn("_late", pauses)
        .withColumn(
            "_open_key", F.coalesce("_open_key", F.when(F.col("_late"), F.col("_first_seq")))
        )
        .withColumn("_open_rank", F.coalesce("_open_rank", F.when(F.col("_late"), F.lit(1))))
        .withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
        .withColumn("_open_at", F.col("_before") + F.col("_open_rank"))
    )
    seeds = placed.select(
        *part,
        F.col("_previous").alias("received_at"),
        F.coalesce(
            F.last("_open_key", ignorenulls=True).over(earlier), F.first("_first_seq").over(by_slice)
        ).alias("_carried_key"),
        (
            F.col("_before")
            - F.coalesce(F.last("_open_at", ignorenulls=True).over(earlier), F.lit(1))
            + 1
        ).alias("_weight"),
    ).withColumn("_seed", F.lit(True))

    # Full pass: a seed row in front of each slice stands for the lines already in the open entry.
    both = cut.select(
        "*", F.lit(1).cast("bigint").alias("_weight"), F.lit(False).alias("_seed")
    ).unionByName(seeds, allowMissingColumns=True)
    ordered = Window.partitionBy(*part).orderBy(F.col("_seed").desc(), "seq")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = (
        dealt(both, *part)
        .withColumn("_previous", F.lag("received_at").over(ordered))
        .withColumn("_running", F.sum("_weight").over(upto))
        .withColumn("_start", ~F.col("_seed") & (F.col("_header") | pauses))
        .withColumn(
            "entry_key",
            F.last(
                F.when(F.col("_seed"), F.col("_carried_key")).when(F.col("_start"), F.col("seq")),
                ignorenulls=True,
            ).over(upto),
        )
        .withColumn(
            "_base",
            F.coalesce(
                F.last(F.when(F.col("_start"), F.col("_running") - 1), ignorenulls=True).over(upto),
                F.lit(0),
            ),
        )
    )
    return (
        opened.where(~F.col("_seed"))
        .withColumn("chunk", F.expr(f"(_running - 1 - _base) div {max(1, max_lines)}"))
        .select(*lines.columns, "entry_key", "chunk")
    )


def assemble_entries(segmented: DataFrame) -> DataFrame:
    """One row per entry part: its lines joined by newlines, with the first line's source and time.

    A group holds at most ``max_lines`` lines, so the collected list is bounded.
    """
    packed = F.sort_array(
        F.collect_list(
            F.struct(
                "seq",
                F.coalesce("line", F.lit("null")).alias("line"),
                "received_at",
                "source_type",
                "source_name",
            )
        )
    )
    part = ["source_id", "entry_key", "chunk"]
    grouped = dealt(segmented, *part).groupBy(*part).agg(packed.alias("_lines"))
    first = F.get("_lines", F.lit(0))
    return grouped.select(
        first["source_type"].alias("source_type"),
        "source_id",
        first["source_name"].alias("source_name"),
        first["received_at"].alias("seen"),
        F.array_join(F.transform("_lines", lambda item: item["line"]), "\n").alias("message"),
        F.size("_lines").cast("bigint").alias("line_count"),
        first["seq"].alias("entry_seq"),
    )


def log_entries(
    lines: DataFrame,
    max_lines: int = MAX_ENTRY_LINES,
    idle_ms: int | None = IDLE_FLUSH_MS,
    slice_width: int = DEFAULT_SLICE_WIDTH,
) -> DataFrame:
    return assemble_entries(segment_entries(lines, max_lines, idle_ms, slice_width))
