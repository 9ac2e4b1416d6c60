"""Stored log lines as the ``log_lines`` table, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.schemas import DEFAULT_SOURCE_TYPE, LOG_LINES

def _projected(rows: DataFrame) -> DataFrame:
    """All ``log_lines`` columns, missing ones filled with their defaults."""
    types = dict(field.split() for field in LOG_LINES.split(", "))
    present = {
        name: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        for name, kind in types.items()
    }
    present["source_type"] = F.coalesce(present["source_type"], F.lit(DEFAULT_SOURCE_TYPE))
    present["stderr"] = F.coalesce(present["stderr"], F.lit(False))
    return rows.select(*[column.alias(name) for name, column in present.items()])


def number_text_lines(rows: DataFrame) -> DataFrame:
    """``seq`` for lines of text files: block start plus the line's place in the block.

    A line takes at least one byte, so numbers rise through a file without meeting the next block.
    Ranking is per block, which the reader's split size bounds. Apply it right after the read (in a
    stream: to the micro-batch), where rows are still in file order.
    """
    in_block = Window.partitionBy("source_id", "_block").orderBy("_row")
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    return placed.withColumn("seq", F.col("_block") + F.row_number().over(in_block) - 1)


def _text_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_name").alias("source_name"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"),
    )


def read_log_lines(spark: SparkSession, path: str, file_format: str = "parquet", **options) -> DataFrame:
    """Lines from Parquet or JSON records of the ``log_lines`` schema, or from plain text files.

    A text file is one source: its path is the source id and its lines are numbered in file order.
    """
    if file_format == "text":
        return _projected(number_text_lines(_text_rows(spark.read.options(**options).text(path))))
    if file_format == "json":
        return _projected(spark.read.options(**options).schema(LOG_LINES).json(path))
    return _projected(spark.read.options(**options).format(file_format).load(path))


def stream_log_lines(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files: int = 1000, **options
) -> DataFrame:
    """The same lines as a stream; ``max_files`` bounds what one micro-batch takes in.

    Text lines carry ``_block`` instead of ``seq``: number them inside the batch with
    :func:`number_text_lines`.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).options(**options)
    if file_format == "text":
        return _text_rows(reader.text(path))
    return _projected(reader.schema(LOG_LINES).format(file_format).load(path))


SOURCE_BUCKETS = 64


def source_bucket(source_id: Column) -> Column:
    return F.pmod(F.xxhash64(source_id), F.lit(SOURCE_BUCKETS)).cast("int")


def store_by_source(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store lines so that those of one source are found without reading the others.

    Lines lie in folders by a hash of their source and, within a folder, sorted by source, so that row
    groups of other sources are skipped too. A source of any size is spread over as many tasks and
    files as its lines fill: rows are dealt out by source and a slice of their numbers.
    """
    placed = lines.withColumn("source_bucket", source_bucket(F.col("source_id")))
    slices = F.expr(f"seq div {LINES_PER_FILE}")
    dealt = placed.repartition("source_bucket", slices).sortWithinPartitions("source_bucket", "source_id", "seq")
    dealt.write.mode(mode).partitionBy("source_bucket").parquet(path)


LINES_PER_FILE = 4_000_000


def read_source(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """The lines of one source from a table that ``store_by_source`` wrote."""
    bucket = spark.range(1).select(source_bucket(F.lit(source_id))).first()[0]
    lines = spark.read.schema(f"{LOG_LINES}, source_bucket int").parquet(path)
    return _projected(lines.where((F.col("source_bucket") == bucket) & (F.col("source_id") == source_id)))


def kafka_log_lines(records: DataFrame) -> DataFrame:
    """Lines from records of the Kafka connector: key = source, one source per partition.

    The offset numbers the lines of a partition; ``in_arrival_order`` numbers those of all. The
    connector itself is an optional package of the cluster.
    """
    return _projected(
        records.select(
            F.coalesce(
                F.col("key").cast("string"),
                F.concat_ws("-", "topic", F.col("partition").cast("string")),
            ).alias("source_id"),
            F.col("topic").alias("source_name"),
            F.col("timestamp").alias("received_at"),
            F.col("value").cast("string").alias("line"),
            F.col("offset").alias("seq"),
        )
    )


def in_arrival_order(lines: DataFrame) -> DataFrame:
    """Lines with a ``seq`` that is one order over all sources; the source's own is ``source_seq``.

    Offsets and byte positions start anew in every partition and file, so they order the lines of one
    source only. Here lines are sorted by arrival, then source, then the source's number, and take
    their number from the sort: unique, rising over its ranges, and dense within each. So a slice of
    numbers holds no more lines than it is wide, however many sources share their offsets.
    """
    ordered = lines.withColumnRenamed("seq", "source_seq").orderBy("received_at", "source_id", "source_seq")
    return ordered.withColumn("seq", F.monotonically_increasing_id())
