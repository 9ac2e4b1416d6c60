"""Stored tables: versioned snapshots and an append table that a retried batch overwrites.

A snapshot is a folder ``v=<version>`` under the table's path; readers name the version they want,
and a retry of the same version replaces only its own folder. Plain Parquet has no merge, so an upsert
reads the buckets of the keys it touches, and the next version holds those anew (``KeyedTable``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.schemas import INCIDENT_EVENTS, INCIDENTS, SAMPLES


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v={version}"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


class MissingSnapshot(RuntimeError):
    """A stream would have to go on from a state that isn't there."""


def read_version(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """One snapshot. Only before the first batch of an empty table is there none.

    Version -1 is what the first batch, or a retry of it, starts from; if the table holds more than
    that batch's own snapshot, a new checkpoint was put on an old table, and that is refused.
    """
    place = version_path(path, version)
    if version < 0:
        newest = latest_version(spark, path)
        if newest > 0:
            raise MissingSnapshot(f"{path} has snapshot {newest}, but the stream starts from its first batch")
        return spark.createDataFrame([], schema)
    if not _exists(spark, place + "/_SUCCESS"):
        raise MissingSnapshot(f"{place} is absent; the stream can't go on from it")
    return spark.read.schema(schema).parquet(place)


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest complete snapshot, -1 if there is none. Lists folder names only."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(root)]
    versions = [int(name.removeprefix("v=")) for name in names if name.startswith("v=")]
    return max((v for v in versions if _exists(spark, version_path(path, v) + "/_SUCCESS")), default=-1)


def write_version(table: DataFrame, path: str, version: int) -> DataFrame:
    """Write a snapshot and return it as read back, which cuts the lineage."""
    place = version_path(path, version)
    table.write.mode("overwrite").parquet(place)
    return table.sparkSession.read.schema(table.schema).parquet(place)


def drop_old_version(spark: SparkSession, path: str, version: int, keep: int = 3) -> None:
    """Remove the snapshot that ``keep`` newer ones have replaced; a retry needs only the last."""
    if version >= keep:
        old = spark._jvm.org.apache.hadoop.fs.Path(version_path(path, version - keep))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(root)] if files.exists(root) else []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@dataclass(frozen=True)
class KeyedTable:
    """A table in buckets by key, of which a batch reads and rewrites only those it touches.

    Data of version n is under ``rows/v=n/bucket=b``; the manifest of version n says which version
    holds each bucket. A manifest has one row per bucket and is written last, so a batch that failed
    half-way has changed nothing, and a retry replaces its own folders.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64
    keep: int = 3

    @property
    def _manifests(self) -> str:
        return f"{self.path.rstrip('/')}/manifest"

    def _rows(self, version: int) -> str:
        return version_path(f"{self.path.rstrip('/')}/rows", version)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``, at most as many as there are."""
        return sorted(row[0] for row in rows.select(self.bucket()).distinct().collect())

    def manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        rows = read_version(spark, self._manifests, version, "bucket int, held_by int")
        return {row["bucket"]: row["held_by"] for row in rows.collect()}

    def latest(self, spark: SparkSession) -> int:
        return latest_version(spark, self._manifests)

    def read(self, spark: SparkSession, version: int, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all or of some buckets."""
        held = self.manifest(spark, version)
        wanted = held if buckets is None else [bucket for bucket in buckets if bucket in held]
        places = [f"{self._rows(held[bucket])}/bucket={bucket}" for bucket in wanted]
        if not places:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*places)

    def write(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        """Version ``version``: the one before, with the touched buckets holding ``rows`` instead."""
        spark = rows.sparkSession
        held = {b: v for b, v in self.manifest(spark, version - 1).items() if b not in set(touched)}
        place = self._rows(version)
        rows.select("*", self.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(place)
        written = [int(name.removeprefix("bucket=")) for name in _children(spark, place) if name.startswith("bucket=")]
        held |= {bucket: version for bucket in written}
        manifest = spark.createDataFrame(sorted(held.items()), "bucket int, held_by int").coalesce(1)
        write_version(manifest, self._manifests, version)
        self._drop_unused(spark, version)

    def _drop_unused(self, spark: SparkSession, version: int) -> None:
        """Delete what none of the last ``keep`` manifests names."""
        first = version - self.keep + 1
        if first <= 0:
            return
        named = {item for v in range(first, version + 1) for item in self.manifest(spark, v).items()}
        for name in _children(spark, f"{self.path.rstrip('/')}/rows"):
            old = int(name.removeprefix("v="))
            if old < first:
                buckets = [child for child in _children(spark, self._rows(old)) if child.startswith("bucket=")]
                unused = [child for child in buckets if (int(child.removeprefix("bucket=")), old) not in named]
                for child in unused:
                    _delete(spark, f"{self._rows(old)}/{child}")
                if len(unused) == len(buckets):
                    _delete(spark, self._rows(old))
        drop_old_version(spark, self._manifests, version, self.keep)


@dataclass(frozen=True)
class CommittedOutput:
    """What a stream hands on: one folder per micro-batch, and a mark for every batch that is complete.

    Readers see marked batches only, and a marked batch is never written again: a retry finds the mark
    and leaves it alone. So whoever reads by batch number reads every row once. The mark is the last thing
    that a step writes; before that, a retry replaces its own folder.
    """

    path: str

    @property
    def rows(self) -> str:
        return f"{self.path.rstrip('/')}/rows"

    def _mark(self, batch_id: int) -> str:
        return f"{self.path.rstrip('/')}/marks/{batch_id}"

    def has(self, spark: SparkSession, batch_id: int) -> bool:
        return _exists(spark, self._mark(batch_id))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.rows}/batch_id={batch_id}")

    def commit(self, spark: SparkSession, batch_id: int) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(self._mark(batch_id))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def batches(self, spark: SparkSession) -> list[int]:
        return sorted(int(name) for name in _children(spark, f"{self.path.rstrip('/')}/marks"))

    def batch(self, spark: SparkSession, batch_id: int, schema) -> DataFrame:
        """One batch; it must be committed."""
        if not self.has(spark, batch_id):
            raise MissingSnapshot(f"{self.path} has no complete batch {batch_id}")
        return spark.read.schema(schema).parquet(f"{self.rows}/batch_id={batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All complete batches, without their numbers."""
        places = [f"{self.rows}/batch_id={batch}" for batch in self.batches(spark)]
        return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def incident_table(path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(path, INCIDENTS, ("fingerprint", "source_id"), buckets)


EVENT_BUCKETS = 64
MERGE = 8


def event_bucket(incident: Column) -> Column:
    """Where the events of an incident are."""
    return F.pmod(F.xxhash64(incident), F.lit(EVENT_BUCKETS)).cast("int")


@dataclass(frozen=True)
class EventLog:
    """An append table in buckets by incident id, whose folders are merged as they become many.

    Batch n writes one folder and then manifest n, the folders that hold the batches up to n. When
    ``merge`` folders of one size class have gathered they are merged into one of the next class, so a
    table of n batches has a number of folders that grows with the logarithm of n, and a row is rewritten
    that often. A retry of the newest batch starts from manifest n - 1 and replaces its own folders; one
    of an older batch, whose rows may have been merged since, replaces its rows in whatever holds them.
    """

    path: str
    merge: int = MERGE

    @property
    def _manifests(self) -> str:
        return f"{self.path.rstrip('/')}/_manifest"

    def _folders(self, spark: SparkSession, version: int) -> list[tuple[str, int]]:
        rows = read_version(spark, self._manifests, version, "folder string, class int").collect()
        return sorted((row["folder"], row["class"]) for row in rows)

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = rows.withColumn("bucket", event_bucket(F.col("incident_id")))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path.rstrip('/')}/{folder}")

    def _read(self, spark: SparkSession, folders: list[str], buckets: bool = False) -> DataFrame:
        schema = f"{INCIDENT_EVENTS}, batch_id int, bucket int"
        frames = [spark.read.schema(schema).parquet(f"{self.path.rstrip('/')}/{folder}") for folder in folders]
        rows = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
        return rows if buckets else rows.drop("bucket")

    def append(self, events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        rows = events.withColumn("batch_id", F.lit(batch_id))
        newest = latest_version(spark, self._manifests)
        if newest > batch_id:
            return self._replace(rows, batch_id, newest)
        before = self._folders(spark, newest if newest < batch_id else self._before(spark, batch_id))
        self._write(rows, f"b{batch_id}")
        held = [*before, (f"b{batch_id}", 0)]
        size = 0
        while len(same := [folder for folder, klass in held if klass == size]) >= self.merge:
            merged = f"m{batch_id}-{size + 1}"
            self._write(self._read(spark, same), merged)
            held = [(folder, klass) for folder, klass in held if klass != size] + [(merged, size + 1)]
            size += 1
        self._publish(spark, held, batch_id)

    def _before(self, spark: SparkSession, batch_id: int) -> int:
        """The newest version older than a batch; batches without events may have none of their own."""
        names = [int(name.removeprefix("v=")) for name in _children(spark, self._manifests) if name.startswith("v=")]
        return max((version for version in names if version < batch_id), default=-1)

    def _replace(self, rows: DataFrame, batch_id: int, newest: int) -> None:
        spark = rows.sparkSession
        held = self._folders(spark, newest)
        others = self._read(spark, [folder for folder, _ in held]).where(F.col("batch_id") != batch_id)
        whole = f"r{newest}-{uuid.uuid4().hex}"
        self._write(others.unionByName(rows), whole)
        self._publish(spark, [(whole, max(klass for _, klass in held))], newest)

    def _publish(self, spark: SparkSession, held: list[tuple[str, int]], version: int) -> None:
        manifest = spark.createDataFrame(held, "folder string, class int").coalesce(1)
        write_version(manifest, self._manifests, version)
        kept = {folder for v in range(max(0, version - 2), version + 1) if _exists(spark, version_path(self._manifests, v) + "/_SUCCESS") for folder, _ in self._folders(spark, v)}
        for name in _children(spark, self.path):
            if name[0] in "bmr" and name not in kept:
                _delete(spark, f"{self.path.rstrip('/')}/{name}")
        drop_old_version(spark, self._manifests, version)

    def read(self, spark: SparkSession) -> DataFrame:
        """All events, each with the batch that wrote it."""
        newest = latest_version(spark, self._manifests)
        return self._read(spark, [] if newest < 0 else [folder for folder, _ in self._folders(spark, newest)])

    def of_incident(self, spark: SparkSession, incident: str) -> DataFrame:
        """The events of one incident: only its bucket is read, in however many folders there are."""
        newest = latest_version(spark, self._manifests)
        rows = self._read(spark, [] if newest < 0 else [folder for folder, _ in self._folders(spark, newest)], buckets=True)
        bucket = spark.range(1).select(event_bucket(F.lit(incident))).first()[0]
        return rows.where((F.col("bucket") == bucket) & (F.col("incident_id") == incident)).drop("bucket")


def append_incident_events(events: DataFrame, path: str, batch_id: int) -> None:
    """Add events under ``batch_id``; a retry of the batch replaces what it wrote before."""
    EventLog(path).append(events, batch_id)


def read_incident_events(spark: SparkSession, path: str) -> DataFrame:
    """All events with the batch that wrote them; none if the table is empty or absent."""
    return EventLog(path).read(spark)


def append_samples(samples: DataFrame, path: str, batch_id: int) -> None:
    """Add first sightings (fingerprint, source_id, sample, first_seq); a retry overwrites its own."""
    samples.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_samples(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Stored first sightings, of all batches or of those before one."""
    schema = f"{SAMPLES}, batch_id int"
    if not _children(spark, path):
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.schema(schema).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    return rows.drop("batch_id")
