"""One arrival order over all sources of a stream.

Offsets, byte positions and row numbers order the rows of one source or of one micro-batch only. Here
numbers are handed out in arrival order, without gaps, and go on from one micro-batch to the next: the
number that comes next is stored with the batch's version. A retried batch starts from the same number
and, since numbers are dense, gives every row the one it had before, however Spark partitions the sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.session import stage
from emberline.sources.tables import CommittedOutput, drop_old_version, read_version, write_version

ROW_BITS = 33
NEXT = "next bigint"
LINE_ORDER = ("received_at", "source_id", "source_seq")


def number_arrivals(rows: DataFrame, order: tuple[str, ...], first: int = 0) -> tuple[DataFrame, int]:
    """(rows with ``seq`` = first, first + 1, ... in the given order, the number that comes next).

    The sort deals rows into ranges; only how many rows each range holds reaches the driver.
    """
    spark = rows.sparkSession
    placed = rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(
        placed.select("*", F.shiftright("_place", ROW_BITS).cast("int").alias("_range"), F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row")).drop("_place"),
        "arrivals",
    )
    sizes = sorted((row["_range"], row["count"]) for row in placed.groupBy("_range").count().collect())
    starts, following = [], first
    for number, size in sizes:
        starts.append((number, following))
        following += size
    begins = spark.createDataFrame(starts, "_range int, _start bigint")
    numbered = placed.join(begins, "_range").withColumn("seq", F.col("_start") + F.col("_row"))
    return numbered.drop("_range", "_start", "_row"), following


def next_number(spark, path: str, version: int) -> int:
    """What the batch after ``version`` starts from."""
    row = read_version(spark, path, version, NEXT).first()
    return row["next"] if row else 0


def keep_number(spark, path: str, version: int, following: int) -> None:
    write_version(spark.createDataFrame([(following,)], NEXT).coalesce(1), path, version)
    drop_old_version(spark, path, version)


@dataclass(frozen=True)
class ArrivalStream:
    """Lines of a stream with ``seq`` in one order over all sources and batches, written as committed batches."""

    output: str
    state: str

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        made = CommittedOutput(self.output)
        if made.has(spark, batch_id):
            return
        lines = batch.withColumnRenamed("seq", "source_seq")
        numbered, following = number_arrivals(lines, LINE_ORDER, next_number(spark, self.state, batch_id - 1))
        made.write(numbered, batch_id)
        keep_number(spark, self.state, batch_id, following)
        made.commit(spark, batch_id)

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            lines.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
