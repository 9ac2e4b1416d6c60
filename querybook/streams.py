"""Registered streaming queries: each feeds whole tables through micro-batches until none is left."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.incidents import numbered_samples
from emberline.sources import tables as stored
from emberline.schemas import LOG_LINES
from emberline.sources.arrivals import ArrivalStream
from emberline.sources.log_lines import stream_log_lines
from emberline.streaming.chain import LogChain, tag_inputs
from emberline.streaming.counts import CountStream, OnTimeStream, watermarked_counts
from emberline.streaming.entries import EntryStream
from emberline.streaming.incidents import IncidentStream, tag_records
from emberline.streaming.stateful import stateful_running_count as stateful_counts
from querybook import sql
from querybook import tables as given
from querybook.queries import _ENTRY_COLUMNS, _COUNTED, _counted_columns, fresh_folder, registered
from querybook.tables import WINDOW, shown

PARTS = 3


def _arrivals(table: DataFrame, order: str, name: str) -> Iterator[str]:
    """A folder that receives the table in three portions, in arrival order; yields after each.

    The stream is started anew for every portion and picks up at its checkpoint.
    """
    place = fresh_folder(table.sparkSession, f"feed-{name}")
    last = table.agg(F.max(order)).first()[0] or 0
    part = F.expr(f"least(({order} * {PARTS}) div {last + 1}, {PARTS - 1})")
    for number in range(PARTS):
        table.where(part == number).write.mode("append").parquet(place)
        yield place


def _stream(spark: SparkSession, place: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(place)


@registered(sql.query([sql.LINES, sql.entries(500, 800)], _ENTRY_COLUMNS))
def stream_entries(spark, d):
    """Entries of a line stream, the open ones flushed at the end."""
    output, checkpoint = fresh_folder(spark, "entries"), fresh_folder(spark, "checkpoint")
    stream = EntryStream(output, fresh_folder(spark, "open-lines"), use_clock=False)
    lines = given.log_lines(spark, d)
    for place in _arrivals(lines, "seq", "lines"):
        stream.start(stream_log_lines(spark, place), checkpoint).awaitTermination()
    stream.flush(spark)
    return shown(spark.read.parquet(output).drop("source_type", "batch_id"))


def _event_streams(spark, d) -> Iterator[DataFrame]:
    events = given.log_events(spark, d)
    for place in _arrivals(events, "seq", "events"):
        yield _stream(spark, place, events.schema)


@registered(sql.to_counted(_COUNTED))
def stream_running_count(spark, d):
    output, checkpoint = fresh_folder(spark, "counted"), fresh_folder(spark, "checkpoint")
    stream = CountStream(output, fresh_folder(spark, "windows"), WINDOW, buckets=8)
    for events in _event_streams(spark, d):
        stream.start(events, checkpoint).awaitTermination()
    return _counted_columns(spark.read.parquet(output))


_TOTALS = "SELECT fingerprint, window_second, count(*) AS window_total FROM counted GROUP BY ALL"
NEVER = "3650 days"


@registered(sql.to_counted(_TOTALS))
def stream_watermarked_counts(spark, d):
    """Window totals by the watermark form, here with a lateness that lets every event in."""
    output, checkpoint = fresh_folder(spark, "watermarked"), fresh_folder(spark, "checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    for events in _event_streams(spark, d):
        query = (
            watermarked_counts(events, WINDOW, NEVER)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return (
        spark.read.parquet(output)
        .groupBy("fingerprint", F.unix_seconds("window_start").alias("window_second"))
        .agg(F.max("window_total").alias("window_total"))
    )


@registered(sql.to_counted(_COUNTED))
def stateful_running_count(spark, d):
    """The counts of every event, with the windows in keyed state."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(
        provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    output, checkpoint = fresh_folder(spark, "stateful"), fresh_folder(spark, "checkpoint")
    try:
        for events in _event_streams(spark, d):
            query = (
                stateful_counts(events, WINDOW)
                .writeStream.format("parquet")
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start(output)
            )
            query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return _counted_columns(spark.read.parquet(output))


def _incident_stream(spark, d) -> IncidentStream:
    """Anomalies and commands folded batch by batch onto stored incidents."""
    records = tag_records(given.summarised_anomalies(spark, d), given.commands(spark, d))
    ordered = records.withColumn("seq", F.coalesce("anomaly.seq", "command.seq"))
    folder, checkpoint = fresh_folder(spark, "incident-stream"), fresh_folder(spark, "checkpoint")
    stream = IncidentStream(f"{folder}/incidents", f"{folder}/events", f"{folder}/rejected", f"{folder}/samples", buckets=8)
    for place in _arrivals(ordered, "seq", "records"):
        stream.start(_stream(spark, place, ordered.schema), checkpoint).awaitTermination()
    return stream


@registered(sql.to_fold(f"SELECT {sql.INCIDENT_COLUMNS} FROM incidents"))
def stream_incidents(spark, d):
    table = _incident_stream(spark, d).table
    return shown(table.read(spark, table.latest(spark)).drop("tags"))


@registered(
    sql.to_anomalies("SELECT fingerprint, source_id, sample, first_seq, position FROM samples", sql.SAMPLES)
)
def stream_incident_samples(spark, d):
    """The samples that a stream has gathered are those of one run over everything."""
    return numbered_samples(stored.read_samples(spark, _incident_stream(spark, d).samples))


_PORTION = f"least((seq * {PARTS}) // ((SELECT max(seq) FROM lines) + 1), {PARTS - 1})"


@registered(
    sql.query(
        [sql.LINES],
        f"""SELECT source_id, line, seq AS source_seq,
        row_number() OVER (ORDER BY {_PORTION}, received_at, source_id, seq) - 1 AS seq FROM lines""",
    )
)
def stream_arrival_order(spark, d):
    """Numbers without gaps over three portions of a line stream, each portion a micro-batch."""
    output, checkpoint = fresh_folder(spark, "numbered"), fresh_folder(spark, "checkpoint")
    stream = ArrivalStream(output, fresh_folder(spark, "next-number"))
    for place in _arrivals(given.log_lines(spark, d), "seq", "lines"):
        stream.start(stream_log_lines(spark, place), checkpoint).awaitTermination()
    numbered = stored.CommittedOutput(output).read(spark, f"{LOG_LINES}, source_seq bigint")
    return numbered.select("source_id", "line", "source_seq", "seq")


def _chain(spark, d) -> LogChain:
    """Lines and commands in three portions through the whole chain, then the end of the stream."""
    events = given.table(spark, d, "events")
    chain = LogChain(
        fresh_folder(spark, "chain"), given.SETTINGS, buckets=8,
        enrich=lambda found: given.with_given_summaries(found, events),
    )
    inputs = tag_inputs(given.log_lines(spark, d), given.commands(spark, d))
    inputs, checkpoint = inputs.withColumn("seq", F.coalesce("line.seq", "command.seq")), fresh_folder(spark, "checkpoint")
    for place in _arrivals(inputs, "seq", "inputs"):
        chain.start(_stream(spark, place, inputs.schema), checkpoint).awaitTermination()
    chain.flush(spark)
    return chain


@registered(sql.to_fold(f"SELECT {sql.INCIDENT_COLUMNS} FROM incidents"))
def stream_lines_to_incidents(spark, d):
    """The incidents that the joined stream holds are those of one run over all lines and commands."""
    table = _chain(spark, d).incidents.table
    return shown(table.read(spark, table.latest(spark)).drop("tags"))


LATENESS = 2 * 86_400
_JUDGED = f"""timed AS (
  SELECT *, epoch_us(coalesce(event_time, ingest_time)) // 1000000 AS second,
         least((seq * {PARTS}) // ((SELECT max(seq) FROM log_events) + 1), {PARTS - 1}) AS portion FROM log_events
), newest AS (
  SELECT p.portion, (SELECT max(second) FROM timed t WHERE t.portion < p.portion) - {LATENESS} AS mark
  FROM (SELECT DISTINCT portion FROM timed) p
), judged AS (
  SELECT timed.*, mark, second // {WINDOW} * {WINDOW} AS window_second,
         coalesce(second // {WINDOW} * {WINDOW} + {WINDOW} <= mark, false) AS late
  FROM timed JOIN newest USING (portion)
)"""
_EVENTS = [sql.LINES, sql.entries(500, 800), sql.EVENTS, _JUDGED]


def _on_time(spark, d) -> OnTimeStream:
    place = fresh_folder(spark, "on-time")
    stream = OnTimeStream(f"{place}/totals", f"{place}/late", f"{place}/newest", WINDOW, LATENESS)
    checkpoint = fresh_folder(spark, "checkpoint")
    for events in _event_streams(spark, d):
        stream.start(events, checkpoint).awaitTermination()
    return stream


@registered(sql.query(_EVENTS, "SELECT fingerprint, window_second, count(*) AS window_total FROM judged WHERE NOT late GROUP BY ALL"))
def stream_on_time_totals(spark, d):
    """Window totals that leave out what came two days after its window had ended."""
    totals = _on_time(spark, d).totals(spark)
    return totals.select("fingerprint", F.unix_seconds("window_start").alias("window_second"), "window_total")


@registered(sql.query(_EVENTS, "SELECT fingerprint, window_second, source_id, seq, level, mark FROM judged WHERE late"))
def stream_late_events(spark, d):
    """The events that those totals leave out, each with the watermark that it missed."""
    late = spark.read.parquet(_on_time(spark, d).late)
    return late.select(
        "fingerprint", F.unix_seconds("window_start").alias("window_second"), "source_id", "seq", "level",
        F.unix_seconds("watermark").alias("mark"),
    )
