"""Token counts through a cache of digests.

A count depends on the content and on the tokenizer, so a cache row is keyed by a digest of both: the
SHA-256 of the normalised content, and that of the tokenizer's file. A run joins the digests of its
documents to the stored counts, encodes each distinct text that has none, once however many copies
there are, appends the new counts to the cache, and joins them back.

The normalisation may only do what cannot change a count. For byte-level vocabularies nothing but
null to empty is safe, and that is the default.

Defined cases: a null text is an empty one, with zero bytes and tokens; repeated rows and copies share
one count and each get a row; an empty table gives an empty result and appends nothing; only the named
columns are read. Two runs that miss the same text at once may both append it: the cache is read with
one row per key.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import stage

CACHE = "content string, version string, n_tokens bigint"
BATCH_CHARS = 1_000_000
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def version_of(path: str) -> str:
    """Digest of a tokenizer file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, without special tokens added at either end."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(found) for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(texts: DataFrame, path: str) -> DataFrame:
    """(content, text) to (content, n_tokens)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(path)
        for frame in frames:
            frame = frame.drop_duplicates("content")
            counts: list[int] = []
            waiting: list[str] = []
            held = 0
            for text in frame["text"]:
                waiting.append(text)
                held += len(text)
                if held > BATCH_CHARS:
                    counts += count(waiting)
                    waiting, held = [], 0
            counts += count(waiting) if waiting else []
            yield pd.DataFrame({"content": frame["content"], "n_tokens": counts})

    return texts.mapInPandas(run, "content string, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """Stored counts, one row per key; empty if nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return stored.groupBy("content", "version").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row: the id, ``n_bytes`` and ``n_tokens``; misses are appended to the folder ``cache``.

    Which texts to encode is settled on digests alone. The texts stay where they are read, and learn
    from a broadcast which of them another copy stands for (nothing stored yet) or which are missing
    (most are stored); the broadcast has at most ``broadcast_rows`` digests. Beyond that, one text per
    digest, picked on the map side, is shuffled to meet the missing digests.
    """
    spark = docs.sparkSession
    version = version_of(path)
    text = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("text")).select(
        "_id", "text", F.unhex(F.sha2("text", 256)).alias("digest")
    )
    known = read_cache(spark, cache).where(F.col("version") == version)
    known = known.select(F.unhex("content").alias("digest"), "n_tokens")
    digests = rows.groupBy("digest").agg(F.min(F.struct("_id")).alias("low"), F.count(F.lit(1)).alias("n"))
    misses = stage(digests.join(known.select("digest"), "digest", "left_anti"), "misses")
    sizes = misses.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    chosen = F.col("_id").eqNullSafe(F.col("low._id"))
    if sizes["repeated"] <= broadcast_rows and known.isEmpty():
        repeated = F.broadcast(misses.where("n > 1").select("digest", "low"))
        texts = rows.join(repeated, "digest", "left").where(F.col("low").isNull() | chosen)
    elif sizes["all"] <= broadcast_rows:
        texts = rows.join(F.broadcast(misses.select("digest", "low")), "digest").where(chosen)
    else:
        texts = rows.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")
    found = texts.select(F.lower(F.hex("digest")).alias("content"), "text")
    count_texts(found, path).select("content", F.lit(version).alias("version"), "n_tokens").write.mode(
        "append"
    ).parquet(cache)
    counts = read_cache(spark, cache).where(F.col("version") == version)
    counts = counts.select(F.unhex("content").alias("digest"), "n_tokens")
    sized = rows.select("_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sized.join(counts, "digest", "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
