"""Incidents from a stream of anomalies and operator commands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.incidents import first_sightings
from emberline.operators.lateness import keep_matching
from emberline.operators.running import DEFAULT_SLICE_WIDTH
from emberline.plans.pipeline import incidents_of
from emberline.session import stage, unstage
from emberline.sources.tables import KeyedTable, append_incident_events, append_samples, incident_table

KEY = ("fingerprint", "source_id")
IDS = "id string, fingerprint string, source_id string"
DIGESTS = "fingerprint string, source_id string, digest binary"


def tag_records(anomalies: DataFrame, commands: DataFrame) -> DataFrame:
    """Both inputs in one stream: each row holds either an anomaly or a command."""
    tagged_anomalies = anomalies.select(F.struct(*anomalies.columns).alias("anomaly"))
    tagged_commands = commands.select(F.struct(*commands.columns).alias("command"))
    return tagged_anomalies.unionByName(tagged_commands, allowMissingColumns=True)


@dataclass(frozen=True)
class IncidentStream:
    """Folds every micro-batch onto the incidents it touches; one incident per key, always.

    ``samples`` gets the first sightings of sample messages, which the batch's anomalies are held
    against, so that cards of stored incidents show every sample since the beginning.

    A batch costs what it touches. Commands name incidents by id, so a second table in buckets by id
    tells their keys; digests of the samples seen are kept in buckets by key. Of all three tables a
    batch reads and rewrites the buckets of its own rows only.
    """

    incidents: str
    events: str
    rejected: str
    samples: str
    slice_width: int = DEFAULT_SLICE_WIDTH
    buckets: int = 64

    @property
    def table(self) -> KeyedTable:
        return incident_table(self.incidents, self.buckets)

    @property
    def ids(self) -> KeyedTable:
        return KeyedTable(f"{self.incidents}-ids", IDS, ("id",), self.buckets)

    @property
    def digests(self) -> KeyedTable:
        return KeyedTable(f"{self.samples}-digests", DIGESTS, KEY, self.buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            anomalies = rows.where(F.col("anomaly").isNotNull()).select("anomaly.*")
            commands = rows.where(F.col("command").isNotNull()).select("command.*")
            # commands name incidents by id, which need not be of a key that the batch holds
            asked = commands.select(F.col("incident_id").alias("id")).where(F.col("id").isNotNull()).distinct()
            ids = self.ids.read(spark, batch_id - 1, self.ids.touched(asked))
            named = ids.join(asked, "id", "left_semi").select(*KEY)
            keys = anomalies.select(*KEY).union(named).union(commands.select(*KEY))
            touched = self.table.touched(keys)
            prior = self.table.read(spark, batch_id - 1, touched)
            outcome = incidents_of(anomalies, commands, prior, self.slice_width)
            append_incident_events(outcome.fold.events, self.events, batch_id)
            outcome.rejected.write.mode("overwrite").parquet(f"{self.rejected}/batch_id={batch_id}")
            self._keep_samples(anomalies, batch_id)
            self.table.write(outcome.fold.incidents, batch_id, touched)
            created = self.table.read(spark, batch_id, touched).select("id", *KEY)
            self._add(self.ids, keep_matching(created, prior, ["id"], "left_anti"), batch_id)
        finally:
            rows.unpersist()

    def _keep_samples(self, anomalies: DataFrame, batch_id: int) -> None:
        """Append the samples that are new; what tells them apart is a digest."""
        spark = anomalies.sparkSession
        seen = first_sightings(anomalies).withColumn("digest", F.unhex(F.md5("sample")))
        known = self.digests.read(spark, batch_id - 1, self.digests.touched(seen))
        new = stage(keep_matching(seen, known, [*KEY, "digest"], "left_anti"), "samples")
        append_samples(new.drop("digest"), self.samples, batch_id)
        self._add(self.digests, new.select(*KEY, "digest"), batch_id)
        unstage(new)

    @staticmethod
    def _add(table: KeyedTable, rows: DataFrame, batch_id: int) -> None:
        """The next version: the one before and these rows."""
        touched = table.touched(rows)
        table.write(table.read(rows.sparkSession, batch_id - 1, touched).unionByName(rows), batch_id, touched)

    def start(self, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            records.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
