import json

from pyspark.sql import functions as F

from emberline.operators.entries import log_entries
from emberline.operators.running import Track, running
from emberline.session import shared_dir, stage
from emberline.sources import tables as stored
from emberline.sources.log_lines import (
    in_arrival_order,
    kafka_log_lines,
    number_text_lines,
    read_log_lines,
    stream_log_lines,
)


def test_text_files_are_numbered_in_file_order(spark, tmp_path):
    for name, size in (("a.log", 3000), ("b.log", 10)):
        (tmp_path / name).write_text("".join(f"line {n}\n" for n in range(size)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_log_lines(spark, str(tmp_path), "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({row.source_id for row in rows}) == 2
    for name, size in (("a.log", 3000), ("b.log", 10)):
        own = sorted((row for row in rows if row.source_name == name), key=lambda row: row.seq)
        assert [row.line for row in own] == [f"line {n}" for n in range(size)]
        assert len({row.seq for row in own}) == size
    assert {row.source_type for row in rows} == {"DOCKER"} and not any(row.stderr for row in rows)


def test_json_lines_fill_defaults(spark, tmp_path):
    record = {"source_id": "c-1", "received_at": "2026-03-21T12:00:00Z", "line": "x", "seq": 5}
    (tmp_path / "a.json").write_text(json.dumps(record) + "\n")
    row = read_log_lines(spark, str(tmp_path), "json").first()
    assert (row.source_type, row.source_id, row.stderr, row.line, row.seq) == ("DOCKER", "c-1", False, "x", 5)


def test_parquet_reading_prunes_and_pushes(spark, tmp_path):
    lines = spark.range(100).select(
        F.concat(F.lit("c-"), (F.col("id") % 3).cast("string")).alias("source_id"),
        F.lit("x").alias("line"),
        F.col("id").alias("seq"),
        F.timestamp_seconds("id").alias("received_at"),
    )
    lines.write.partitionBy("source_id").parquet(str(tmp_path / "p"))
    found = read_log_lines(spark, str(tmp_path / "p")).where("source_id = 'c-1'").select("line", "seq")
    assert found.count() == 33
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan and "received_at" not in plan


def test_streamed_text_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\n two\nthree\n")
    seen = []

    def take(batch, batch_id):
        seen.extend((r.line, r.seq) for r in number_text_lines(batch).orderBy("seq").collect())

    stream_log_lines(spark, str(tmp_path / "in"), "text").writeStream.foreachBatch(take).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    assert seen == [("one", 0), (" two", 1), ("three", 2)]


def test_kafka_records(spark):
    records = spark.createDataFrame(
        [(bytearray(b"c-1"), bytearray(b"x"), "logs", 0, 7), (None, bytearray(b" y"), "logs", 2, 8)],
        "key binary, value binary, topic string, partition int, offset bigint",
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    rows = {r.seq: (r.source_id, r.source_name, r.line) for r in kafka_log_lines(records).collect()}
    assert rows == {7: ("c-1", "logs", "x"), 8: ("logs-2", "logs", " y")}
    assert log_entries(kafka_log_lines(records)).count() == 2


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.read_version(spark, path, -1, "a int").count() == 0
    stored.write_version(spark.createDataFrame([(1,)], "a int"), path, 0)
    stored.write_version(spark.createDataFrame([(2,)], "a int"), path, 0)
    stored.write_version(spark.createDataFrame([(3,)], "a int"), path, 1)
    assert [r.a for r in stored.read_version(spark, path, 0, "a int").collect()] == [2]
    assert [r.a for r in stored.read_version(spark, path, 1, "a int").collect()] == [3]


def test_stage_uses_the_folder_of_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert shared_dir(spark) == before.rstrip("/")
    table = stage(spark.range(3), "t")
    assert table.count() == 3
    assert table.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file://"))


def test_many_partitions_that_share_offsets(spark):
    """2000 topic partitions, each numbered from zero: slices stay small, and arrival orders the counts."""
    width = 10
    lines = spark.range(20_000).select(
        F.format_string("p-%04d", F.col("id") % 2000).alias("source_id"),
        F.lit("logs").alias("source_name"),
        F.timestamp_seconds(F.col("id")).alias("received_at"),
        F.lit("x").alias("line"),
        F.expr("id div 2000").alias("seq"),
    )
    ordered = stage(in_arrival_order(lines.repartition(6)), "ordered")
    sizes = ordered.groupBy(F.expr(f"seq div {width}")).count()
    assert sizes.agg(F.max("count")).first()[0] <= width
    assert ordered.select("seq").distinct().count() == 20_000
    counted = running(
        ordered.withColumn("k", F.lit("one")), ["k"], ["seq", "source_id"], [Track("n", "sum", F.lit(1).cast("bigint"))], width
    )
    assert counted.where(F.unix_seconds("received_at") + 1 != F.col("n")).count() == 0
