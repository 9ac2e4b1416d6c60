"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words under the ones of a fixed mask; words under its zeros may differ. The
seeds of all positions of all documents meet those of the benchmark. Around each hit, the words of
document and item that lie opposite each other are scored, one up for equal and one down for different
words, and the best run counts: so a copy is found although words in it were replaced, and a chance
hit is not. Words are runs of letters and digits, in lower case.

Items of fewer than ``SHORT`` words have windows of four words as seeds, or of all their words if they
are fewer, and need a score of three quarters of their words, 13 at most, and all of up to four: any run
that scores so much holds four equal words in a row, so none is missed.

All steps are DataFrame functions. The benchmark's seeds are broadcast if there are at most
``broadcast_seeds`` of them; with more, both sides are shuffled by seed and only hits meet texts again.

Defined cases: null texts have no words, and items without words are never reported; a document that holds an item many times is reported once with that item, by its best
overlap; repeated ids are reported together; empty tables give no rows; a null id is an id; other
columns pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import unused
from emberline.session import stage

# Of 13 words in a row, eight must agree for a hit.
MASKS = ("1101100101101", "1011010011011")
WINDOWS = ("1111", "111", "11", "1")
MIN_OVERLAP = 13
SHORT = 20
SHARE = 0.75
AROUND = 16
BROADCAST_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seed_at(words: Column, at: Column, number: int, mask: str) -> Column:
    """Hash of the words under the ones of a mask that starts at a position."""
    return F.xxhash64(F.lit(number), *[F.get(words, at + i) for i, sign in enumerate(mask) if sign == "1"])


def seeds_of(number: Column) -> list[tuple[int, str, Column]]:
    """All masks by number, and if an item of a number of words has seeds by it."""
    masks = [(mask, number >= SHORT) for mask in MASKS]
    masks += [(window, (number < SHORT) & (F.least(number, F.lit(len(WINDOWS[0]))) == len(window))) for window in WINDOWS]
    return [(i, mask, fits) for i, (mask, fits) in enumerate(masks)]


def seed_rows(texts: DataFrame, masks: list[tuple[int, str, Column]]) -> DataFrame:
    """(``*``, ``words``) to one row per position and mask, with ``at``, ``number`` and ``seed``.

    Positions are exploded and hashed as plain columns, not inside a function over the array, so that
    the whole way from the words to the join is generated code.
    """
    least = min((len(mask) for _, mask, _ in masks), default=1)
    long = texts.where(F.size("words") >= least)
    placed = long.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    seeds = [
        F.when(fits & (F.col("at") + len(mask) <= F.size("words")), seed_at(F.col("words"), F.col("at"), number, mask))
        for number, mask, fits in masks
    ]
    made = placed.select("*", F.posexplode(F.array(*seeds) if seeds else F.array().cast("array<bigint>")).alias("number", "seed"))
    return made.where(F.col("seed").isNotNull())


def windows(
    left: Column, left_at: Column, right: Column, right_at: Column, span: Column, around: int = AROUND
) -> tuple[Column, Column]:
    """The words of both sides that lie opposite each other near a hit, as two arrays of equal length."""
    before = F.least(F.lit(around), left_at, right_at)
    after = F.least(F.lit(around), F.size(left) - left_at - span, F.size(right) - right_at - span)
    length = before + after + span
    return F.slice(left, left_at - before + 1, length), F.slice(right, right_at - before + 1, length)


def needed(number: Column, min_overlap: int) -> Column:
    """The score that an item of a number of words has to reach."""
    share = F.greatest(F.ceil(number * SHARE), F.least(number, F.lit(len(WINDOWS[0]))))
    return F.when(number < SHORT, F.least(F.lit(min_overlap), share)).otherwise(min_overlap)


def overlap(left: Column, right: Column) -> Column:
    """Best score of a run of opposite words: equal ones count up, others down."""
    steps = F.zip_with(left, right, lambda a, b: F.when(a == b, 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, value: Column) -> Column:
        run = F.greatest(state["run"] + value, F.lit(0))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(steps, start, step, lambda state: state["best"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", min_overlap: int = MIN_OVERLAP,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(id, item id, overlap): each document with each benchmark item of which it holds a passage."""
    named = benchmark.select(
        F.col(f"`{item_id_col}`").alias("_item"), words_of(F.col(f"`{item_text_col}`")).alias("words")
    )
    masks = seeds_of(F.size("words"))
    items = seed_rows(named, masks)
    numbers = {row["number"]: row["count"] for row in items.groupBy("number").count().collect()}
    span = F.element_at(F.array(*[F.lit(len(mask)) for _, mask, _ in masks]), F.col("number") + 1)
    items = items.select("_item", F.col("words").alias("_item_words"), F.col("at").alias("_item_at"), span.alias("_span"), "seed")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    # documents have seeds only by the masks that some item has
    seeds = seed_rows(texts, [(number, mask, F.lit(True)) for number, mask, _ in masks if number in numbers]).drop("number")
    if sum(numbers.values()) <= broadcast_seeds:
        hits = seeds.join(F.broadcast(items), "seed")
    else:
        bare = seeds.select("_id", "at", "seed").join(items, "seed").drop("seed")
        hits = bare.withColumnRenamed("_id", "_hit").join(texts, F.col("_hit").eqNullSafe(F.col("_id")))
        hits = hits.where(F.size("words") >= F.col("at") + F.col("_span"))
    # A hit leaves the generated code with two short windows, not with the words of its document. That
    # both are looked at twice below keeps the optimizer from moving them into the score.
    left, right = windows(F.col("words"), F.col("at"), F.col("_item_words"), F.col("_item_at"), F.col("_span"))
    near = hits.select("_id", "_item", needed(F.size("_item_words"), min_overlap).alias("_needed"), left.alias("_left"), right.alias("_right"))
    even = F.size("_left") == F.size("_right")
    scored = near.select("_id", "_item", "_needed", F.when(even, overlap(F.col("_left"), F.col("_right"))).alias("overlap"))
    # the score is filtered after it is aggregated: as a condition of the join it would take positions
    # and join out of the generated code, and write a text's words once per position
    best = scored.groupBy("_id", "_item", "_needed").agg(F.max("overlap").alias("overlap"))
    reached = best.where(F.col("overlap") >= F.col("_needed"))
    # items with one id may need different scores
    found = reached.groupBy("_id", "_item").agg(F.max("overlap").alias("overlap"))
    return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id_col), F.col("overlap").cast("bigint").alias("overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is not reported by ``find_leaks``.

    Reported ids are stored first; unless there are very many, texts needn't be shuffled to leave them out.
    """
    leak = unused(docs, "leak")
    leaks = stage(find_leaks(docs, benchmark, id_col, text_col).select(F.col(f"`{id_col}`").alias(leak)).distinct(), "leaks")
    if leaks.count() <= BROADCAST_SEEDS:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, F.col(f"`{id_col}`").eqNullSafe(F.col(leak)), "left_anti")
