"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(value: Column) -> Column:
    return F.translate(value, ASCII_UPPER, ASCII_LOWER)


def utf8(text: str | None) -> bytes:
    """The text's bytes; null counts as empty."""
    return (text or "").encode("utf-8", "replace")


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its columns are called."""
    taken = {column.lower() for column in frame.columns}
    while name in taken:
        name = f"_{name}"
    return name


ARROW = {
    "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def per_batch(
    docs: DataFrame, id_col: str, text_col: str, schema: str, compute: Callable[[], Callable[[list[str]], Iterator[list[tuple]]]]
) -> DataFrame:
    """One output row per input row: the id, then the columns of ``schema``.

    ``compute`` runs once per task and returns the function from the texts of a batch to runs of rows,
    in order. Only two columns leave the scan, whatever else the input holds; null texts are empty, and
    ids of any type, null or not, pass through as they are.
    """
    fields = [part.split() for part in schema.split(", ")]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compute()
        for batch in batches:
            start = 0
            for rows in made([text or "" for text in batch.column("_text").to_pylist()]):
                ids = batch.column("_id").slice(start, len(rows))
                start += len(rows)
                columns = [pa.array([row[i] for row in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["_id", *[name for name, _ in fields]])

    pairs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return pairs.mapInArrow(run, f"_id {id_type}, {schema}").withColumnRenamed("_id", id_col)


def per_text(
    docs: DataFrame, id_col: str, text_col: str, schema: str, compute: Callable[[], Callable[[str], tuple]]
) -> DataFrame:
    """``per_batch`` for a function of one text."""

    def whole():
        one = compute()
        return lambda texts: iter([[one(text) for text in texts]])

    return per_batch(docs, id_col, text_col, schema, whole)
