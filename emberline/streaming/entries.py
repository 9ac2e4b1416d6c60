"""Entries from a stream of lines.

Each micro-batch runs the batch operator over the lines still open from the batch before plus the
new ones. Lines of the entry that may still grow go into the state table: at most ``max_lines`` per
source. A busy source is split over tasks exactly as in a batch run.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.entries import assemble_entries, segment_entries
from emberline.operators.running import DEFAULT_SLICE_WIDTH
from emberline.schemas import IDLE_FLUSH_MS, LOG_LINES, MAX_ENTRY_LINES
from emberline.session import stage
from emberline.sources.tables import (
    drop_old_version,
    latest_version,
    read_version,
    write_version,
)


def split_open(
    segmented: DataFrame,
    now: dt.datetime | None,
    max_lines: int = MAX_ENTRY_LINES,
    idle_ms: int = IDLE_FLUSH_MS,
    place: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Segmented lines as (finished entry parts, open lines).

    The last part of a source stays open until it is full or a pause passed. ``now`` is the clock the
    pause is measured against; None leaves every unfinished part open. The open parts, at most one per
    source, are read twice; with ``place`` they are found once and stored there.
    """
    part = ["source_id", "entry_key", "chunk"]
    parts = segmented.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.max("seq").alias("_seq"),
        F.max_by("received_at", "seq").alias("_time"),
    )
    tail = F.max_by(F.struct("entry_key", "chunk", "_lines", "_time"), "_seq")
    open_parts = (
        parts.groupBy("source_id").agg(tail.alias("_tail")).where(F.col("_tail._lines") < max_lines)
    )
    if now is not None:
        waited = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("_tail._time")
        open_parts = open_parts.where(F.coalesce(waited < idle_ms * 1000, F.lit(True)))
    open_parts = open_parts.select(
        F.col("source_id").alias("_s"),
        F.col("_tail.entry_key").alias("_e"),
        F.col("_tail.chunk").alias("_c"),
    )
    if place is not None:
        open_parts = stage(open_parts, "open", place)
    # Joined on the whole part key, of which a part has at most max_lines rows.
    same = (
        F.col("source_id").eqNullSafe(F.col("_s"))
        & (F.col("entry_key") == F.col("_e"))
        & (F.col("chunk") == F.col("_c"))
    )
    finished = segmented.join(open_parts, same, "left_anti")
    opened = segmented.join(open_parts, same, "left_semi")
    return assemble_entries(finished), opened.drop("entry_key", "chunk")


@dataclass(frozen=True)
class EntryStream:
    """Where a stream of entries keeps its output and its state.

    An entry that may still grow is finished when a pause has passed, by the machine's clock; with
    ``arrival_clock`` by the newest line of any source, which gives a replay the same entries.
    """

    output: str
    state: str
    max_lines: int = MAX_ENTRY_LINES
    idle_ms: int = IDLE_FLUSH_MS
    slice_width: int = DEFAULT_SLICE_WIDTH
    use_clock: bool = True
    arrival_clock: bool = False

    def process(self, batch: DataFrame, batch_id: int, last: bool = False) -> None:
        """One micro-batch. A retry reads the same prior state and overwrites its own output.

        ``last`` finishes what would stay open.
        """
        spark = batch.sparkSession
        prior = read_version(spark, self.state, batch_id - 1, LOG_LINES)
        names = [field.split()[0] for field in LOG_LINES.split(", ")]
        now = dt.datetime.now(dt.timezone.utc) if self.use_clock else None
        arrived = batch.where(F.col("line").isNotNull()).select(*names)
        lines = prior.unionByName(arrived)
        if self.arrival_clock:
            now = lines.agg(F.max("received_at")).first()[0]
        segmented = stage(
            segment_entries(lines, self.max_lines, self.idle_ms, self.slice_width),
            "segmented",
            f"{self.state}-segmented/v={batch_id}",
        )
        if last:
            finished, opened = assemble_entries(segmented), segmented.drop("entry_key", "chunk").limit(0)
        else:
            place = f"{self.state}-open/v={batch_id}"
            finished, opened = split_open(segmented, now, self.max_lines, self.idle_ms, place)
        finished.write.mode("overwrite").parquet(f"{self.output}/batch_id={batch_id}")
        write_version(opened, self.state, batch_id)
        for path in (self.state, f"{self.state}-segmented", f"{self.state}-open"):
            drop_old_version(spark, path, batch_id)

    def start(
        self, lines: DataFrame, checkpoint: str, heartbeat_rows: int | None = None, **trigger
    ) -> StreamingQuery:
        """Start the stream. A micro-batch runs only if there is something to read, so an entry would
        wait in a source that has gone quiet; ``heartbeat_rows`` per second keep the clock going (with
        a processing-time trigger) and are dropped here.
        """
        if heartbeat_rows:
            beat = lines.sparkSession.readStream.format("rate").option("rowsPerSecond", heartbeat_rows).load()
            empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in lines.schema.fields]
            lines = lines.unionByName(beat.select(*empty))
        return (
            lines.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def flush(self, spark: SparkSession) -> None:
        """End of the stream: write what is still open as entries, under the next batch number."""
        last = latest_version(spark, self.state)
        opened = read_version(spark, self.state, last, LOG_LINES)
        rest = assemble_entries(
            segment_entries(opened, self.max_lines, self.idle_ms, self.slice_width)
        )
        rest.write.mode("overwrite").parquet(f"{self.output}/batch_id={last + 1}")
