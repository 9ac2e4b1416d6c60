"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# All timestamps are UTC instants; AQE re-plans joins and splits skewed partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def build_session(app_name: str = "emberline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster the launcher chooses master and sizes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
    return configured.rstrip("/")


def use_scratch_dir(spark: SparkSession) -> None:
    """For tests, benches and other runs in one process: set the shared folder if it is unset.

    A cluster has no folder that this could choose, so there the setting must exist.
    """
    local = spark.sparkContext.master.split("[")[0] == "local"
    if local and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="emberline-"))


def stage(table: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and return it as read back.

    Between the steps of a chain this cuts the lineage: later steps read a columnar table, scan only
    the columns they need, and do not repeat the work above it when they use it more than once or
    when an executor is lost. Name a ``path`` to keep the table; otherwise a new folder is taken, which
    ``remove_staged`` deletes.
    """
    spark = table.sparkSession
    place = path or f"{shared_dir(spark)}/emberline-{name}-{uuid.uuid4().hex}"
    if path is None:
        _staged.append(place)
    # Nobody reads the shuffle files of the write again: what follows reads the table.
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        table.write.mode("overwrite").parquet(place)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(table.schema).parquet(place)


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: list[str] = []


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables whose consumers are done, each as returned by ``stage``."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if place.getName().startswith("emberline-"):
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_staged(spark: SparkSession) -> int:
    """Delete the tables that ``stage`` has written under names of its own; returns how many.

    Call it when the results that read them are written or collected: a staged table lives until its
    consumer is done, and only the caller knows when that is.
    """
    done = len(_staged)
    while _staged:
        place = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return done
