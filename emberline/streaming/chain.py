"""Lines and operator commands to incidents and notifications, in one stream.

Every micro-batch goes through all steps: entries, their events in order of arrival, running counts,
anomalies and incidents, notifications. A step reads what the one before it has committed for the
batch, and its own state of the version before; it writes its output and its next state, then commits.
A retried micro-batch repeats the steps that had not committed and no others, so every line takes effect
once.

Counts and incidents follow the order of arrival, but an entry is finished later than others that began
after it. So events and commands wait until no line before them is still open, and then pass in order.
How the stream is cut into batches has no influence on the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.functions.identity import incident_id
from emberline.operators.counting import anomalies_of_counted, with_window
from emberline.operators.notifications import NotificationSettings, build_notifications
from emberline.operators.parsing import log_events
from emberline.operators.summaries import resolve_summary
from emberline.plans.pipeline import Settings
from emberline.schemas import COMMANDS, IDLE_FLUSH_MS, LOG_LINES, STATE_TTL_SECONDS, SUMMARY
from emberline.sources.arrivals import keep_number, next_number, number_arrivals
from emberline.sources.tables import CommittedOutput, drop_old_version, read_version, write_version
from emberline.streaming.counts import CountStream
from emberline.streaming.entries import EntryStream
from emberline.streaming.incidents import IncidentStream, tag_records

RECORD = f"line struct<{LOG_LINES}>, command struct<{COMMANDS}>"
LINE_FIELDS = [field.split()[0] for field in LOG_LINES.split(", ")]
COMMAND_FIELDS = [field.split()[0] for field in COMMANDS.split(", ")]


def tag_inputs(lines: DataFrame, commands: DataFrame) -> DataFrame:
    """Both inputs in one stream: each row holds either a line or a command."""
    one = lines.select(F.struct(*LINE_FIELDS).alias("line"))
    other = commands.select(F.struct(*COMMAND_FIELDS).alias("command"))
    return one.unionByName(other, allowMissingColumns=True)


def numbered_inputs(records: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Lines and commands with ``seq`` handed out anew, in one order of arrival."""
    timed = records.select(
        "*",
        F.coalesce("line.received_at", "command.ts").alias("_at"),
        F.coalesce("line.source_id", "command.source_id").alias("_source"),
        F.coalesce("line.seq", "command.seq").alias("_own"),
        F.col("command").isNotNull().alias("_later"),
    )
    numbered, following = number_arrivals(timed, ("_at", "_source", "_later", "_own"), first)
    renumbered = [
        F.when(F.col(name).isNotNull(), F.col(name).withField("seq", F.col("seq"))).alias(name) for name in ("line", "command")
    ]
    return numbered.select(*renumbered), following


@dataclass(frozen=True)
class LogChain:
    """The whole chain under one folder.

    ``renumber`` hands out arrival numbers to lines and commands whose own ``seq`` orders one source only.
    ``enrich`` may add summaries to the anomalies of a batch. Notifications are written if settings are
    given, one per anomaly, identified by ``incident_id`` and ``seq``.
    """

    root: str
    settings: Settings = Settings()
    buckets: int = 64
    ttl_seconds: int = STATE_TTL_SECONDS
    renumber: bool = False
    enrich: Callable[[DataFrame], DataFrame] | None = None
    mail: NotificationSettings | None = None

    def output(self, step: str) -> CommittedOutput:
        return CommittedOutput(f"{self.root.rstrip('/')}/{step}")

    def _state(self, step: str) -> str:
        return f"{self.root.rstrip('/')}/{step}/state"

    @property
    def entries(self) -> EntryStream:
        idle = IDLE_FLUSH_MS if self.settings.idle_ms is None else self.settings.idle_ms
        return EntryStream(
            self.output("entries").rows, self._state("entries"), self.settings.max_lines, idle,
            self.settings.slice_width, arrival_clock=True,
        )

    @property
    def counts(self) -> CountStream:
        settings = self.settings
        return CountStream(
            self.output("counts").rows, self._state("counts"), settings.window_seconds, settings.slice_width,
            self.ttl_seconds, self.buckets,
        )

    @property
    def incidents(self) -> IncidentStream:
        place = f"{self.root.rstrip('/')}/incidents"
        return IncidentStream(
            f"{place}/table", f"{place}/events", f"{place}/rejected", f"{place}/samples", self.settings.slice_width, self.buckets
        )

    def _step(self, spark: SparkSession, step: str, batch_id: int, work: Callable[[], None]) -> None:
        made = self.output(step)
        if not made.has(spark, batch_id):
            work()
            made.commit(spark, batch_id)

    def process(self, batch: DataFrame, batch_id: int, last: bool = False) -> None:
        """One micro-batch of tagged inputs; with ``last`` nothing is left open."""
        spark = batch.sparkSession
        self._step(spark, "inputs", batch_id, lambda: self._inputs(batch, batch_id))
        inputs = self.output("inputs").batch(spark, batch_id, RECORD)
        self._step(spark, "entries", batch_id, lambda: self._entries(inputs, batch_id, last))
        self._step(spark, "released", batch_id, lambda: self._release(inputs, batch_id, last))
        self._step(spark, "counts", batch_id, lambda: self._count(spark, batch_id))
        self._step(spark, "anomalies", batch_id, lambda: self._detect(spark, batch_id))
        self._step(spark, "incidents", batch_id, lambda: self._fold(spark, batch_id))

    def _inputs(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*[F.col(part).cast(kind).alias(part) for part, kind in (("line", f"struct<{LOG_LINES}>"), ("command", f"struct<{COMMANDS}>"))])
        if self.renumber:
            rows, following = numbered_inputs(rows, next_number(spark, self._state("inputs"), batch_id - 1))
            self.output("inputs").write(rows, batch_id)
            keep_number(spark, self._state("inputs"), batch_id, following)
        else:
            self.output("inputs").write(rows, batch_id)

    def _entries(self, inputs: DataFrame, batch_id: int, last: bool) -> None:
        lines = inputs.where(F.col("line").isNotNull()).select("line.*")
        self.entries.process(lines, batch_id, last)

    def _entry_events(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return log_events(spark.read.parquet(f"{self.output('entries').rows}/batch_id={batch_id}"))

    def _release(self, inputs: DataFrame, batch_id: int, last: bool) -> None:
        """Events and commands before the first line that is still open; the others wait."""
        spark, place = inputs.sparkSession, self._state("released")
        arrived = tag_records(self._entry_events(spark, batch_id), inputs.where(F.col("command").isNotNull()).select("command.*"))
        arrived = arrived.withColumnRenamed("anomaly", "event")
        rows = read_version(spark, place, batch_id - 1, arrived.schema).unionByName(arrived)
        seq = F.coalesce("event.seq", "command.seq")
        first = None if last else read_version(spark, self._state("entries"), batch_id, LOG_LINES).agg(F.min("seq")).first()[0]
        ready = F.lit(True) if first is None else F.coalesce(seq < F.lit(first), F.lit(True))
        self.output("released").write(rows.where(ready), batch_id)
        write_version(rows.where(~ready), place, batch_id)
        drop_old_version(spark, place, batch_id)

    def _released(self, spark: SparkSession, batch_id: int, part: str) -> DataFrame:
        schema = tag_records(self._entry_events(spark, batch_id), spark.createDataFrame([], COMMANDS)).withColumnRenamed("anomaly", "event").schema
        return self.output("released").batch(spark, batch_id, schema).where(F.col(part).isNotNull()).select(f"{part}.*")

    def _count(self, spark: SparkSession, batch_id: int) -> None:
        self.counts.process(self._released(spark, batch_id, "event"), batch_id)

    def _detect(self, spark: SparkSession, batch_id: int) -> None:
        events = with_window(self._released(spark, batch_id, "event"), self.settings.window_seconds)
        schema = events.withColumn("window_count", F.lit(0).cast("bigint")).schema
        counted = self.output("counts").batch(spark, batch_id, schema)
        found = anomalies_of_counted(counted, self.settings.threshold)
        self.output("anomalies").write(self.enrich(found) if self.enrich else found, batch_id)
        if self.mail:
            rows, nothing = self._anomalies(spark, batch_id), F.lit(None).cast(SUMMARY)
            given = F.col("summary") if "summary" in rows.columns else nothing
            sent = build_notifications(rows.withColumn("summary", resolve_summary(given, nothing)), self.mail)
            CommittedOutput(f"{self.root.rstrip('/')}/mail").write(sent.withColumn("incident_id", incident_id("fingerprint", "source_id")), batch_id)

    def _anomalies(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.output('anomalies').rows}/batch_id={batch_id}")

    def _fold(self, spark: SparkSession, batch_id: int) -> None:
        records = tag_records(self._anomalies(spark, batch_id), self._released(spark, batch_id, "command"))
        self.incidents.process(records, batch_id)

    def notifications(self, spark: SparkSession) -> DataFrame:
        """Those of complete batches; each anomaly's once."""
        done = self.output("anomalies").batches(spark)
        places = [f"{self.root.rstrip('/')}/mail/rows/batch_id={batch}" for batch in done]
        return spark.read.parquet(*places)

    def start(self, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            records.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def flush(self, spark: SparkSession) -> None:
        """End of the stream: what is open or waiting passes as a last batch of its own."""
        done = self.output("incidents").batches(spark)
        self.process(spark.createDataFrame([], RECORD), max(done, default=-1) + 1, last=True)
