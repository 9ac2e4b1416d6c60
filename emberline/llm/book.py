"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    near_duplicates,
    pitman_yor,
    private_data,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash_trie,
    source_divergence,
    token_counts,
    url_reputation,
)
from emberline.llm.frames import documents
from emberline.llm.sql import HARD_NEGATIVES, SOURCE_DIVERGENCE, URL_REPUTATION
from emberline.llm.url_reputation import ALLOW, BLOCK, Rule
from emberline.session import shared_dir, stage

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
COUNT_FILE = "byte_bpe_50k.json"
MAX_TOKENS = 1024
URL_RULES = [
    Rule("org/", ALLOW),
    Rule("example.org/es/", BLOCK),
    Rule("example.org/en/1", BLOCK),
    Rule("com/fr/", ALLOW),
    Rule("com/de/", BLOCK),
]


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.report(documents(spark, sf_dir))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_FILE)
    return byte_bpe.digest_documents(documents(spark, sf_dir), str(path), public_tokenizers.PATTERN, units=byte_bpe.UNITS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    counts = token_counts.count_tokens(documents(spark, sf_dir), str(public_tokenizers.path(COUNT_FILE)), cache)
    return counts.withColumn("over_limit", counts["n_tokens"] > MAX_TOKENS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(documents(spark, sf_dir), benchmark)


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_reputation.judge_urls(pages.select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = stage(quality_rules.judge_table(documents(spark, sf_dir)), "quality")
    return quality_rules.with_verdict(judged).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    codes = hard_negatives.quantised(F.col("embedding"))
    vectors = table.select(F.col("vec_id").alias("id"), label.alias("label"), codes.alias("codes"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(documents(spark, sf_dir))


LLM_BOOK: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_pitman_yor": (op1_pitman_yor, None),
    "op2_private_data": (op2_private_data, None),
    "op3_near_duplicates": (op3_near_duplicates, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op5_token_counts": (op5_token_counts, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_url_reputation": (op7_url_reputation, URL_REPUTATION),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_quality_classifier": (op10_quality_classifier, None),
    "op11_source_divergence": (op11_source_divergence, SOURCE_DIVERGENCE),
    "op12_hard_negatives": (op12_hard_negatives, HARD_NEGATIVES),
    "op13_simhash_trie": (op13_simhash_trie, None),
}
