"""Running counts over a stream of events.

Late events are counted: state holds a total per (fingerprint, window) and no watermark drops rows. A
window that the late rule has dropped counts from one again, as in a batch run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.functions.times import event_or_ingest_time
from emberline.operators.counting import count_onto, held_after, with_window
from emberline.operators.lateness import BEFORE, ORDER, STATE
from emberline.operators.running import DEFAULT_SLICE_WIDTH, Track, running
from emberline.schemas import STATE_TTL_SECONDS, WINDOW_SECONDS
from emberline.sources.tables import KeyedTable, drop_old_version, read_version, write_version

HELD = f"{STATE}, seen_at timestamp"


def count_batch(
    state: DataFrame, events: DataFrame, window_seconds: int, slice_width: int = DEFAULT_SLICE_WIDTH
) -> tuple[DataFrame, DataFrame]:
    """(events with ``window_count``, the windows held after them), by the late rule per event.

    The rule follows the order of arrival, so the counts don't depend on where batches are cut.
    """
    counted, fold = count_onto(with_window(events, window_seconds), state, window_seconds, slice_width)
    return counted, held_after(counted, state, fold)


def with_last_seen(held: DataFrame, before: DataFrame, events: DataFrame) -> DataFrame:
    """The windows held, each with the arrival of the last event of its fingerprint."""
    seen = (
        events.select("fingerprint", F.struct(*ORDER).alias("_at"), F.col("ingest_time").alias("seen_at"))
        .unionByName(before.select("fingerprint", "seen_at"), allowMissingColumns=True)
        .groupBy(F.col("fingerprint").alias("_f"))
        .agg(F.max(F.struct("_at", "seen_at")).alias("_last"))
        .select("_f", "_last.seen_at")
    )
    return held.join(seen, F.col("fingerprint").eqNullSafe(F.col("_f")), "left").drop("_f")


def expire(held: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Delete what no event from ``now`` on would find (``lives``). Event times have no part in it."""
    age = F.unix_seconds(now) - F.unix_seconds("seen_at")
    return held.where(F.coalesce(age <= ttl_seconds, F.lit(True)))


def _seconds_between(earlier: Column, later: Column) -> Column:
    return F.unix_seconds(later) - F.unix_seconds(earlier)


def paused(events: DataFrame, before: DataFrame, ttl_seconds: int) -> DataFrame:
    """Fingerprints that may have paused for longer: what bounds every pause exceeds the limit."""
    times = events.select("fingerprint", "ingest_time", F.lit(True).alias("_new")).unionByName(
        before.select("fingerprint", F.col("seen_at").alias("ingest_time"), F.lit(False).alias("_new"))
    )
    spans = times.groupBy("fingerprint").agg(
        F.min("ingest_time").alias("_from"), F.max("ingest_time").alias("_to"), F.max("_new").alias("_live")
    )
    longer = _seconds_between(F.col("_from"), F.col("_to")) > ttl_seconds
    return spans.where(F.col("_live") & longer).select("fingerprint")


def lives(events: DataFrame, before: DataFrame, ttl_seconds: int, slice_width: int = DEFAULT_SLICE_WIDTH) -> DataFrame:
    """Events with ``life``: how many pauses of more than ``ttl_seconds`` their fingerprint had made.

    A pause is the time from one arrival of a fingerprint to its next, the stored last one included, so
    it is where it is however the events are cut into batches.
    """
    last = before.groupBy("fingerprint").agg(F.max("seen_at").alias("ingest_time"))
    given = last.select("*", F.lit(BEFORE).cast("bigint").alias("seq"), F.lit(True).alias("_given"))
    both = events.unionByName(given, allowMissingColumns=True)
    key = ["fingerprint"]
    previous = Track("_previous", "last", F.col("ingest_time"))
    timed = running(both, key, ORDER, [previous], slice_width, include_current=False)
    pause = F.coalesce(_seconds_between(F.col("_previous"), F.col("ingest_time")) > ttl_seconds, F.lit(False))
    counted = running(timed, key, ORDER, [Track("life", "sum", pause.cast("bigint"))], slice_width)
    return counted.where(F.col("_given").isNull()).drop("_given", "_previous")


@dataclass(frozen=True)
class CountStream:
    """Running counts batch by batch; the state is a table in buckets by fingerprint.

    ``ttl_seconds`` bounds the state: after a pause longer than that a fingerprint starts from nothing.
    Which events that concerns follows from their arrival alone. Rows that no later event can find
    are deleted when their bucket is next rewritten.
    """

    output: str
    state: str
    window_seconds: int = WINDOW_SECONDS
    slice_width: int = DEFAULT_SLICE_WIDTH
    ttl_seconds: int = STATE_TTL_SECONDS
    buckets: int = 64

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.state, HELD, ("fingerprint",), self.buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = batch.persist()
        try:
            touched = self.table.touched(events)
            prior = self.table.read(spark, batch_id - 1, touched).persist()
            state = self._count(events, prior, f"{self.output}/batch_id={batch_id}")
            now = F.lit(events.agg(F.min("ingest_time")).first()[0]).cast("timestamp")
            self.table.write(expire(with_last_seen(state, prior, events), now, self.ttl_seconds), batch_id, touched)
            prior.unpersist()
        finally:
            events.unpersist()

    def _count(self, events: DataFrame, prior: DataFrame, place: str) -> DataFrame:
        """Write the counted events and return the windows held after them."""
        rows, known = with_window(events, self.window_seconds), prior.drop("seen_at")
        rested = not paused(events, prior, self.ttl_seconds).isEmpty()
        if rested:
            # a fingerprint and its life together are what is counted
            numbered = lives(rows, prior, self.ttl_seconds, self.slice_width)
            rows = numbered.withColumn("fingerprint", F.struct("fingerprint", "life")).drop("life")
            known = known.withColumn("fingerprint", F.struct("fingerprint", F.lit(0).cast("bigint").alias("life")))
        counted, fold = count_onto(rows, known, self.window_seconds, self.slice_width)
        made = counted.withColumn("fingerprint", F.col("fingerprint.fingerprint")) if rested else counted
        made.write.mode("overwrite").parquet(place)
        if not rested:
            written = events.sparkSession.read.schema(counted.schema).parquet(place)
            return held_after(written, known, fold)
        held = held_after(counted, known, fold)
        last = rows.groupBy("fingerprint.fingerprint").agg(F.max("fingerprint.life").alias("_life"))
        last = last.select(F.col("fingerprint").alias("_f"), "_life")
        held = held.select("fingerprint.*", "window_start", "window_total")
        held = held.join(last, F.col("fingerprint").eqNullSafe(F.col("_f")), "left")
        return held.where(F.col("life") == F.coalesce("_life", F.lit(0))).drop("life", "_f", "_life")

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            events.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def watermarked_counts(
    events: DataFrame, window_seconds: int = WINDOW_SECONDS, lateness: str = "2 minutes"
) -> DataFrame:
    """The alternative that drops late events: a native windowed aggregation with a watermark.

    Counts are pre-aggregated before the shuffle, and old windows leave the state by themselves.
    """
    timed = events.withColumn("_ts", event_or_ingest_time()).withWatermark("_ts", lateness)
    return (
        timed.groupBy("fingerprint", F.window("_ts", f"{max(1, window_seconds)} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("window_total"))
        .select("fingerprint", F.col("_w.start").alias("window_start"), "window_total")
    )


NEWEST = "newest timestamp"


@dataclass(frozen=True)
class OnTimeStream:
    """Window totals that leave out late events, and the events left out.

    The watermark of a micro-batch is the newest time of all batches before it less ``lateness_seconds``.
    An event whose window had ended by then is late: it goes to ``late`` with the watermark that it
    missed. All others are added up per batch in ``output``; ``totals`` adds the batches.
    """

    output: str
    late: str
    state: str
    window_seconds: int = WINDOW_SECONDS
    lateness_seconds: int = 120

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_ts", event_or_ingest_time()).persist()
        try:
            row = read_version(spark, self.state, batch_id - 1, NEWEST).first()
            before = F.lit(row["newest"] if row else None).cast("timestamp")
            mark = F.timestamp_seconds(F.unix_seconds(before) - self.lateness_seconds)
            windowed = with_window(rows, self.window_seconds)
            ended = F.unix_seconds("window_start") + max(1, self.window_seconds) <= F.unix_seconds(mark)
            missed = F.coalesce(ended, F.lit(False))
            late = windowed.where(missed).withColumn("watermark", mark).drop("_ts")
            late.write.mode("overwrite").parquet(f"{self.late}/batch_id={batch_id}")
            counted = windowed.where(~missed).groupBy("fingerprint", "window_start").agg(F.count("*").alias("window_total"))
            counted.write.mode("overwrite").parquet(f"{self.output}/batch_id={batch_id}")
            newest = rows.select(F.greatest(before, F.max("_ts")).alias("newest"))
            write_version(newest.coalesce(1), self.state, batch_id)
            drop_old_version(spark, self.state, batch_id)
        finally:
            rows.unpersist()

    def totals(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.output)
        return rows.groupBy("fingerprint", "window_start").agg(F.sum("window_total").alias("window_total"))

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            events.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
