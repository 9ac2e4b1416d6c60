"""From raw documents to training data: every stage reads what the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import byte_bpe, decontamination, near_duplicates, private_data, quality_rules
from emberline.llm.book import BPE_FILE
from emberline.llm.frames import documents
from emberline.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in the text and the length brought up to date."""
    masked = private_data.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its id, the number of tokens, and digests of the ids and the decoded bytes."""
    return byte_bpe.digest_documents(docs, str(public_tokenizers.path(BPE_FILE)), public_tokenizers.PATTERN, units=byte_bpe.UNITS)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", clean_of_benchmark),
    ("personal data", private),
    ("encoding", tokens),
]

# Expectation-maximisation, MinHash and the tokenizer can't be expressed in SQL; tests/llm holds the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what each stage returns is written to the shared folder and reread."""
    docs, place = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{place}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{place}/{number}")
    return docs
