"""Quality rules under weak supervision: rules vote or abstain, a label model weighs them.

Instead of rejecting a document that fails any rule, the rates at which each rule is right are
estimated over all documents by expectation-maximisation (``weak_labels``), and a document is kept if
its posterior probability of being good is high enough.

Defined cases: a null text counts as empty; an empty text has no words and fails the base test; rows
are judged one by one, so repeated rows and repeated ids each get their own verdict; an empty table
gives an empty result; other columns of any name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import weak_labels
from emberline.llm.frames import per_text
from emberline.llm.text_stats import STATS_SCHEMA, TextStats, text_stats
from emberline.llm.weak_labels import ABSTAIN, BAD, GOOD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_POSTERIOR = 0.5


def _band(value: float, good_below: float, bad_above: float) -> int:
    return BAD if value > bad_above else GOOD if value < good_below else ABSTAIN


def votes(stats: TextStats) -> list[int]:
    """What each rule says; all abstain on a text without words."""
    if stats.n_words == 0:
        return [ABSTAIN] * N_RULES
    words, letters, lines = stats.n_words, max(stats.n_letters, 1), max(stats.n_lines, 1)
    mean_length = stats.word_chars / words
    return [
        _band(stats.n_symbols / words, 0.05, 0.2),
        _band(stats.n_upper / letters, 0.3, 0.5),
        _band(stats.n_repeat_words / words, 0.25, 0.5),
        _band(stats.n_dup_lines / lines, 0.3, 0.5),
        _band(stats.n_bare / words, 0.08, 0.2),
        _band(stats.n_shouts / words, 0.1, 0.3),
        _band(stats.top_word / words, 0.2, 0.35) if words >= 20 else ABSTAIN,
        GOOD if 3 <= mean_length <= 9 else BAD if mean_length < 2 or mean_length > 15 else ABSTAIN,
        _band(1 - stats.n_letters / max(stats.word_chars, 1), 0.25, 0.4),
    ]


N_RULES = 9


def _judged(text: str) -> tuple:
    stats = text_stats(text)
    return (*stats, weak_labels.pattern(votes(stats)))


def judge_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, its counts and the code of its votes."""
    return per_text(docs, id_col, text_col, f"{STATS_SCHEMA}, votes bigint", lambda: _judged)


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def with_verdict(judged: DataFrame, model: weak_labels.LabelModel | None = None, base: bool = True) -> DataFrame:
    """``judge_table`` rows plus ``quality`` (posterior), ``base_failed`` and ``kept``."""
    model = model or weak_labels.fit(judged, "votes", N_RULES)
    quality = weak_labels.posterior(model, F.col("votes"))
    good = F.col("quality") >= MIN_POSTERIOR
    return judged.withColumns({"quality": quality, "base_failed": base_failed()}).withColumn(
        "kept", good & ~F.col("base_failed") if base else good
    )


def fit(docs: DataFrame, text_col: str = "text") -> weak_labels.LabelModel:
    texts = docs.select(F.lit(0).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return weak_labels.fit(judge_table(texts, "_row", "_text"), "votes", N_RULES)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they had.

    The votes are taken twice, once to fit and once to filter, which needs neither a shuffle nor a
    copy of the texts.
    """
    model = fit(docs, text_col)

    @F.pandas_udf("struct<n_words:bigint,n_repeat_words:bigint,votes:bigint>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                stats = text_stats(text or "")
                rows.append((stats.n_words, stats.n_repeat_words, weak_labels.pattern(votes(stats))))
            yield pd.DataFrame(rows, columns=["n_words", "n_repeat_words", "votes"])

    seen = judged(F.col(f"`{text_col}`"))
    words, repeats, code = seen["n_words"], seen["n_repeat_words"], seen["votes"]
    failed = (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)
    return docs.where(~failed & (weak_labels.posterior(model, code) >= MIN_POSTERIOR))
