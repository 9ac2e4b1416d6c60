"""How far the sources of a language differ in their words: one-hot level products.

A group is a source within a language. A group's count of a term is its level there, and a level fixes
the term's share p of the group. Comparing two groups term by term takes, for every pair of groups, the
joint table of their levels: how many terms have level a here and level b there. With one indicator
column per (group, level), level zero included, and one row per term, all these tables are the product
of the matrix with its transpose. The product is taken in blocks: of terms, which add up, and of groups.
Entries are counts below 2**24, so single precision holds them exactly; each table cell is then priced
with 64-bit integers.

Defined cases: null text, language and source are empty strings, which are a language and a source like
others; a text without terms still makes its group known; a language without kept terms has pairs of
value zero and no terms; repeated rows count each time; an empty table gives an empty result; ids and
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.frames import utf8
from emberline.session import stage

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BLOCK_ROWS = 100_000
BLOCK_GROUPS = 256
BLOCK_TERMS = 2_048
CELLS = 2_000_000
HELD_TERMS = 300_000
PIECE = 1 << 20

# every byte that is part of a term as it is or in lower case, a blank for all others
TERM_BYTES = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or 97 <= code <= 122 else 32 for code in range(256)
)
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in runs, so that a very long one isn't held as a list of words."""
    raw = utf8(text).translate(TERM_BYTES)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (uses, texts) in held.items():
                terms = [term.decode("utf-8", "replace") for term in uses]
                same = [[lang] * len(terms), [source] * len(terms)]
                columns = [*same, terms, list(uses.values()), [texts[term] for term in uses]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type) for values, field in zip(columns, COUNTED)], schema=COUNTED
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                uses, texts = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(uses), set()
                for terms in terms_of(text):
                    uses.update(terms)
                    seen.update(terms)
                texts.update(seen)
                size += len(uses) - before
                if size > HELD_TERMS:
                    yield from flushed()
                    size = 0
        yield from flushed()

    read = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(f"c{i}") for i, name in enumerate((lang_col, source_col, text_col))]
    partial = docs.select(*read).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term that occurs n times among ``total``, of ``terms`` kept ones."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", scaled, (total + terms).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` for arrays, ``whole`` being occurrences plus kept terms: long division by thousands."""
    rest, p = n + 1, np.zeros(len(n), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        digits = rest // whole
        rest -= digits * whole
        p = p * 1000 + digits
    return 1 + p


def one_hot(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms by groups of counts as indicator columns, sorted by group: (matrix, group and level of each)."""
    n_terms, n_groups = levels.shape
    group = np.broadcast_to(np.arange(n_groups), levels.shape)
    distinct = [np.unique(levels[:, g], return_inverse=True) for g in range(n_groups)]
    starts = np.cumsum([0] + [len(found) for found, _ in distinct])
    matrix = np.zeros((n_terms, starts[-1]), dtype=np.float32)
    for g, (_, place) in enumerate(distinct):
        matrix[np.arange(n_terms), starts[g] + place] = 1
    return matrix, np.repeat(group[0], np.diff(starts)), np.concatenate([found for found, _ in distinct])


def joint_tables(left: np.ndarray, right: np.ndarray):
    """The joint level tables of all groups on the left with all on the right, as one matrix.

    Returns it with the (group, level) of its rows and of its columns.
    """
    x, *rows = one_hot(left)
    y, *columns = one_hot(right)
    return x.T @ y, tuple(rows), tuple(columns)


def priced(left: np.ndarray, right: np.ndarray, left_whole: np.ndarray, right_whole: np.ndarray) -> np.ndarray:
    """Summed divergence of every left group (p) from every right group (q) over the terms of the rows."""
    table, (group_a, level_a), (group_b, level_b) = joint_tables(left, right)
    p, q = shares(level_a, left_whole[group_a]), shares(level_b, right_whole[group_b])
    gap = p[:, None] - q[None, :]
    cells = table.astype(np.int64) * (gap * gap // q[None, :])
    first = np.searchsorted(group_a, np.arange(left.shape[1]))
    second = np.searchsorted(group_b, np.arange(right.shape[1]))
    return np.add.reduceat(np.add.reduceat(cells, first, axis=0), second, axis=1)


def _levels(rows: pd.DataFrame, term: np.ndarray, n_terms: int, sources: dict[str, int]) -> np.ndarray:
    levels = np.zeros((n_terms, len(sources)), dtype=np.int64)
    levels[term, rows["source"].map(sources).to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return levels


def _price_block(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of terms for two blocks of groups. Rows without a term name the groups."""
    known = frame[frame["term"].isna()].sort_values("source")
    rows = frame[frame["term"].notna()]
    same = bool((frame["i"] == frame["j"]).all())
    sides = [known[known["left"]], known if same else known[~known["left"]]]
    sources = [{source: k for k, source in enumerate(side["source"])} for side in sides]
    wholes = [side["whole"].to_numpy(dtype=np.int64) for side in sides]
    total = np.zeros((len(sources[0]), len(sources[1])), dtype=np.int64)
    # terms in order of use: neighbours have few different levels between them
    term, _ = pd.factorize(rows["term"])
    n_terms = int(term.max()) + 1 if len(term) else 0
    uses = np.zeros(n_terms, dtype=np.int64)
    np.add.at(uses, term, rows["n"].to_numpy(dtype=np.int64))
    place = np.empty(n_terms, dtype=np.int64)
    place[np.argsort(uses, kind="stable")] = np.arange(n_terms)
    rows = rows.assign(place=place[term]).sort_values("place", kind="stable")
    at, start, step = rows["place"].to_numpy(), 0, BLOCK_TERMS
    while start < n_terms and total.size:
        end = min(n_terms, start + step)
        part = rows.iloc[np.searchsorted(at, start) : np.searchsorted(at, end)]
        halves = [part[part["left"]], part if same else part[~part["left"]]]
        left, right = (
            _levels(half, half["place"].to_numpy() - start, end - start, side) for half, side in zip(halves, sources)
        )
        columns = [sum(len(np.unique(side[:, g])) for g in range(side.shape[1])) for side in (left, right)]
        if columns[0] * columns[1] > CELLS and end - start > 1:
            step = max(1, (end - start) // 2)
            continue
        total += priced(left, right, *wholes)
        start, step = end, min(BLOCK_TERMS, step * 2)
    # terms of the block that no group here has: level zero on both sides
    absent = int(known["here"].iloc[0]) - n_terms
    if absent and total.size:
        p, q = (shares(np.zeros(len(whole), dtype=np.int64), whole) for whole in wholes)
        total += absent * ((p[:, None] - q[None, :]) ** 2 // q[None, :])
    lang = frame["lang"].iloc[0]
    pairs = [(lang, a, b, int(total[x, y])) for a, x in sources[0].items() for b, y in sources[1].items() if a != b]
    return pd.DataFrame(pairs, columns=["lang", "source", "item", "value"])


def pair_values(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    A task gets a block of terms of a language and two blocks of its groups. Blocks are cut so that a
    task holds about ``BLOCK_ROWS`` counts of ``BLOCK_GROUPS`` groups, however many there are.
    """
    cuts = langs.select(
        "lang", "n_terms",
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("int").alias("term_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("n_groups") / BLOCK_GROUPS)).cast("int").alias("group_blocks"),
    )
    own = F.pmod(F.xxhash64("source"), "group_blocks").cast("int")
    counts = kept.join(cuts, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "term_blocks").cast("int").alias("b"), own.alias("own"), "group_blocks",
        "source", "term", "n", F.lit(None).cast("bigint").alias("whole"), F.lit(None).cast("bigint").alias("here"),
    )
    here = counts.groupBy("lang", "b", "term").agg(F.lit(1)).groupBy("lang", "b").agg(F.count("*").alias("here"))
    named = groups.join(cuts, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("b"), own.alias("own"), "group_blocks",
        "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"),
        (F.col("total") + F.col("n_terms")).alias("whole"),
    )
    named = named.join(here, ["lang", "b"], "left").na.fill(0, ["here"])
    every = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1))
    both = counts.unionByName(named)
    columns = ["lang", "b", "i", "j", "left", "source", "term", "n", "whole", "here"]
    lefts = both.select("*", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("left")).select(*columns)
    rights = both.select("*", F.col("own").alias("j"), every.alias("i"), F.lit(False).alias("left")).where(F.col("i") != F.col("j"))
    dealt = lefts.unionByName(rights.select(*columns))
    parts = dealt.groupBy("lang", "b", "i", "j").applyInPandas(_price_block, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other one, and by which terms.

    Part ``pair`` has all other sources of the language, part ``term`` the ``top_terms`` terms that the
    source uses more than its language does.
    """
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "terms")
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("uses")).where(F.col("docs") >= min_docs)
    kept = stage(counts.drop("docs").join(wide.drop("docs"), ["lang", "term"]), "kept")
    known = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
    ).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = known.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "rows"])
    groups = stage(groups, "groups")
    vocabulary = kept.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n_terms"))
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("rows").alias("n_rows"), F.count("*").alias("n_groups")
    )
    langs = stage(langs.join(vocabulary, "lang", "left").na.fill(0, ["n_terms"]), "langs")

    pairs = pair_values(kept, groups, langs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")
    )

    sized = groups.select("lang", "source", "total").join(langs.select("lang", "n_terms", "lang_total"), "lang")
    terms = kept.join(sized, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"),
        share(F.col("uses"), F.col("lang_total"), F.col("n_terms")).alias("q"),
    )
    above = terms.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value")
    )
    above = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(above)
