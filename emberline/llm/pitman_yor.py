"""A hierarchical Pitman-Yor language model of word pairs, sampled by Gibbs and scored over a corpus.

Every word is a restaurant for the words that follow it; all of them share one parent, the restaurant
of single words, whose base is uniform over the known words and one more. The ``c`` customers of a
word in a context sit at ``t`` tables, and each table is a customer of that word in the parent. Given
everything else, the number of tables has the conditional probability

    p(t)  ~  S(c, t) * prod_{k<t} (strength + discount * (others + k)) * parent(word)**t

with S the generalised Stirling numbers, which is the seating with the arrangement at the tables
summed out. A sweep draws every t from it. Predictive probabilities are averaged over several seatings.

How it runs. Documents are cut into chunks, each a table row with its distinct words and its tokens as
numbers. Everything that depends on the whole corpus is asked for by chunk, once per distinct word or
pair and never per occurrence, so the hottest word of the corpus is one entry per chunk:

* chunks send counts of distinct words to word blocks, and counts of distinct pairs to pair blocks
  (by context; the pairs of very frequent contexts are dealt out by both words);
* a pair that occurs once has one table; only the others are sampled. What a block knows of its
  words' totals, and the words of the seatings, travels as the customers saved, c - t, summed;
* in the end blocks answer each chunk in the order in which it asked, and the chunk scores its texts.

Tables between the steps are in the shared folder. Words are known by 64-bit hashes, in pairs by 48
bits. Blocks grow in number with the tokens, not in size. The driver sees totals, and the identities
of at most ``4 * blocks`` hot contexts.

Defined cases: a null text is an empty one, whose only token is its end; a null id is held out if the
empty text would be; repeated rows are learnt from and scored as often as they occur; without training
documents all scores are 0, and an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import utf8
from emberline.session import stage, unstage

CHUNK_TOKENS = 1_500_000
TOKENS_PER_BLOCK = 600_000
EXACT_CUSTOMERS = 64
CELLS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``sweeps`` over all seatings, the last of which draws ``samples`` seatings that are averaged."""

    sweeps: int = 2
    samples: int = 2
    strength: float = 1.0
    parent_strength: float = 1.0
    seed: int = 7


@dataclass(frozen=True)
class Corpus:
    """Totals of the training documents."""

    tokens: int
    types: int
    blocks: int
    word_blocks: int
    hot: np.ndarray
    discount: float = 0.75
    parent_discount: float = 0.75


@dataclass(frozen=True)
class Parent:
    """Totals of the parent restaurant in one seating."""

    customers: float
    tables: float


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def packed_ids(ids: np.ndarray) -> bytes:
    """48-bit numbers, byte plane by byte plane; mostly ascending ones as differences."""
    steps = np.diff(ids, prepend=np.uint64(0)) & np.uint64(2**48 - 1)
    return packed(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)


def unpacked_ids(data: bytes) -> np.ndarray:
    planes = unpacked(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64) & np.uint64(2**48 - 1)


def cut(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) for each distinct key, places in order."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, edges) if len(order) else []:
        yield int(keys[places[0]]), places


def spread(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


# ---- chunks


def chunks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Rows of chunks: ids, which are held out, tokens per document, word hashes, and token numbers.

    The words of a chunk are in order of their hashes. Number ``ends`` is the end of a text, which is
    also the context of its first word.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId(), 0
        chunk = _Chunk()
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                chunk.add(text, batch.column("held")[i].as_py())
                if chunk.size >= CHUNK_TOKENS:
                    chunk.ids.append(batch.column("id").slice(start, i + 1 - start))
                    yield chunk.row((place << 32) + number)
                    chunk, start, number = _Chunk(), i + 1, number + 1
            chunk.ids.append(batch.column("id").slice(start))
        if chunk.lengths:
            yield chunk.row((place << 32) + number)

    schema = (
        f"chunk bigint, ids array<{id_type}>, held array<boolean>, lengths array<int>, n_all bigint, "
        "n_train bigint, ends int, words binary, counts binary, tokens binary"
    )
    return rows.mapInArrow(run, schema)


class _Chunk:
    def __init__(self):
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[b""]  # the end of a text
        self.ids, self.held, self.lengths, self.tokens, self.size = [], [], [], [], 0

    def add(self, text: str | None, held: bool) -> None:
        words = utf8(text).lower().split()
        numbers = np.zeros(len(words) + 1, dtype=np.int32)
        numbers[:-1] = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        self.tokens.append(numbers)
        self.held.append(held)
        self.lengths.append(len(numbers))
        self.size += len(numbers)

    def row(self, name: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known), np.uint64, len(self.known))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        tokens = rank[np.concatenate(self.tokens)]
        train = np.repeat(~np.array(self.held, dtype=bool), self.lengths)
        counts = np.bincount(tokens[train], minlength=len(order)).astype(np.int32)
        ids = pa.concat_arrays(self.ids)
        one = lambda values, kind: pa.array([values], kind)
        return pa.RecordBatch.from_arrays(
            [
                one(name, pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                one(self.held, pa.list_(pa.bool_())),
                one(self.lengths, pa.list_(pa.int32())),
                one(len(tokens), pa.int64()),
                one(int(train.sum()), pa.int64()),
                one(int(rank[0]), pa.int32()),
                one(packed(hashes[order]), pa.binary()),
                one(packed(counts), pa.binary()),
                one(packed(tokens), pa.binary()),
            ],
            ["chunk", "ids", "held", "lengths", "n_all", "n_train", "ends", "words", "counts", "tokens"],
        )


def pairs_of(tokens: np.ndarray, ends: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a chunk as (context, word), in order, and the pair of each token."""
    before = np.empty(len(tokens), dtype=np.int64)
    before[0], before[1:] = ends, tokens[:-1]
    codes, which = np.unique(before * size + tokens, return_inverse=True)
    return codes // size, codes % size, which


def pair_blocks(short: np.ndarray, u: np.ndarray, w: np.ndarray, corpus: Corpus) -> np.ndarray:
    """The block of each pair, by its context, or by both words if the context is hot."""
    block = spread(short[u], corpus.blocks)
    if len(corpus.hot):
        at = np.flatnonzero(np.isin(short, corpus.hot)[u])
        block[at] = spread(short[u[at]] * np.uint64(31) + short[w[at]], corpus.blocks)
    return block


# ---- word blocks: totals of words


def ask_words(table: DataFrame, word_blocks: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                hashes, counts = unpacked(row.words, np.uint64), unpacked(row.counts, np.int32)
                out = [
                    (block, row.chunk, hashes[at].tobytes(), packed(counts[at]))
                    for block, at in cut(spread(hashes >> np.uint64(16), word_blocks))
                ]
                yield pd.DataFrame(out, columns=["block", "chunk", "words", "counts"])

    asked = table.select("chunk", "words", "counts")
    return asked.mapInPandas(run, "block bigint, chunk bigint, words binary, counts binary")


def word_totals(asked: DataFrame, hot_above: float) -> DataFrame:
    """Per word block a row of kind 0 with its words and counts, and per chunk one of kind 1: where its words are."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(data, dtype=np.uint64) for data in frame["words"]]
        counts = np.concatenate([unpacked(data, np.int32) for data in frame["counts"]])
        words, place = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(place, counts, len(words)).astype(np.int64)
        block = int(frame["block"].iloc[0])
        hot = (words[totals > hot_above] >> np.uint64(16)).astype(np.int64).tolist()
        stats = (int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum()))
        out = [(0, block, -1, packed(words), packed(totals), hot, *stats)]
        edges = np.cumsum([len(x) for x in lists])[:-1]
        for chunk, at in zip(frame["chunk"], np.split(place.astype(np.int32), edges)):
            out.append((1, block, chunk, packed(at), b"", [], 0, 0, 0))
        return pd.DataFrame(out, columns=["kind", "block", "chunk", "x", "y", "hot", "types", "ones", "twos"])

    schema = "kind int, block bigint, chunk bigint, x binary, y binary, hot array<bigint>, types bigint, ones bigint, twos bigint"
    return asked.groupBy("block").applyInPandas(run, schema)


# ---- pair blocks: counts of pairs, and the seatings of those that occur more than once


def ask_pairs(table: DataFrame, corpus: Corpus) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                short = unpacked(row.words, np.uint64) >> np.uint64(16)
                tokens = unpacked(row.tokens, np.int32)
                train = np.repeat(~np.array(row.held, dtype=bool), row.lengths)
                u, w, which = pairs_of(tokens, row.ends, len(short))
                counts = np.bincount(which[train], minlength=len(u)).astype(np.int32)
                out = []
                for block, at in cut(pair_blocks(short, u, w, corpus)):
                    first = np.flatnonzero(np.diff(u[at], prepend=-1))
                    runs = np.diff(np.append(first, len(at))).astype(np.int32)
                    out.append((block, row.chunk, packed_ids(short[u[at][first]]), packed(runs), packed_ids(short[w[at]]), packed(counts[at])))
                yield pd.DataFrame(out, columns=["block", "chunk", "u", "runs", "w", "counts"])

    asked = table.select("chunk", "held", "lengths", "ends", "words", "tokens")
    return asked.mapInPandas(run, "block bigint, chunk bigint, u binary, runs binary, w binary, counts binary")


SEATED = "kind int, block bigint, other bigint, x binary, y binary, z binary, n bigint, ones bigint, twos bigint"
SEATED_NAMES = [part.split()[0] for part in SEATED.split(", ")]


def pair_totals(asked: DataFrame, corpus: Corpus) -> DataFrame:
    """Per pair block a row of kind 0 with the pairs to seat, and per chunk one of kind 1 with its codes.

    Code 0 is a pair that training doesn't hold, 1 one that it holds once, and 2 + i the i-th to seat.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        u = np.concatenate([np.repeat(unpacked_ids(a), unpacked(b, np.int32)) for a, b in zip(frame["u"], frame["runs"])])
        lists = [unpacked_ids(data) for data in frame["w"]]
        w = np.concatenate(lists)
        counts = np.concatenate([unpacked(data, np.int32) for data in frame["counts"]])
        order = np.lexsort((w, u))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        totals = np.bincount(group, counts).astype(np.int64)
        first = order[new]
        seat = np.flatnonzero(totals > 1)
        code = np.minimum(totals, 1)
        code[seat] = 2 + np.arange(len(seat))
        pu, pw = u[first[seat]], w[first[seat]]
        words = np.unique(np.concatenate([pu, pw]))
        words = words[np.argsort(spread(words, corpus.word_blocks), kind="stable")]
        rank = np.argsort(words, kind="stable")
        place = lambda ids: rank[np.searchsorted(words, ids, sorter=rank)].astype(np.int32)
        block = int(frame["block"].iloc[0])
        seated = np.concatenate([place(pu), place(pw), totals[seat].astype(np.int32)])
        ones, twos = int((totals == 1).sum()), int((totals == 2).sum())
        out = [(0, block, -1, packed(words), packed(seated), b"", len(seat), ones, twos)]
        edges = np.cumsum([len(x) for x in lists])[:-1]
        for chunk, codes in zip(frame["chunk"], np.split(code[group].astype(np.uint32), edges)):
            out.append((1, block, chunk, packed(codes), b"", b"", 0, 0, 0))
        return pd.DataFrame(out, columns=SEATED_NAMES)

    return asked.groupBy("block").applyInPandas(run, SEATED)


class Seats:
    """The pairs of a block: numbers of context and word among its words, customers."""

    def __init__(self, row):
        self.words = unpacked(row.x, np.uint64)
        self.u, self.w, self.c = unpacked(row.y, np.int32).reshape(3, -1)

    def saved(self, tables: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers less tables per word, as a context and as a follower."""
        less = (self.c - tables).astype(np.float64)
        size = len(self.words)
        return (
            np.bincount(self.u, less, size)[places].astype(np.int64),
            np.bincount(self.w, less, size)[places].astype(np.int64),
        )

    def messages(self, block: int, tables: np.ndarray, corpus: Corpus) -> list[tuple]:
        """One row of kind 2 per word block: the words, and what the seatings (one per row) save."""
        out = []
        for other, places in cut(spread(self.words, corpus.word_blocks)):
            saved = [self.saved(row, places) for row in tables]
            out.append((2, block, other, packed_ids(self.words[places]), packed(np.array(saved)), b"", 0, 0, 0))
        return out


def stirling_logs(size: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``size``."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(size + 1)
    for c in range(size):
        grow = np.full(size + 1, -np.inf)
        usable = (t >= 1) & (t <= c)
        grow[usable] = np.log(c - discount * t[usable]) + table[c, usable]
        opened = np.concatenate([[-np.inf], table[c, :-1]])
        table[c + 1] = np.logaddexp(grow, opened)
    return table


def draw_tables(
    c: np.ndarray, base: np.ndarray, others: np.ndarray, strength: float, discount: float, rng
) -> np.ndarray:
    """Tables per dish, each from its conditional probability given the rest.

    With more than EXACT_CUSTOMERS, all of a dish's customers leave and sit down again in order, in
    steps of a thirty-second of those seated.
    """
    tables = np.minimum(c, 1).astype(np.int64)
    stirling = stirling_logs(EXACT_CUSTOMERS, discount)
    small = np.flatnonzero((c > 1) & (c <= EXACT_CUSTOMERS))
    for size, places in cut(c[small]):
        rows = small[places]
        ts = np.arange(1, size + 1)
        for part in np.array_split(rows, max(1, len(rows) * size // CELLS)):
            opening = np.log(strength + discount * (others[part, None] + ts - 1)) + np.log(base[part, None])
            logs = stirling[size, 1 : size + 1] + np.cumsum(opening, axis=1)
            tables[part] = 1 + np.argmax(logs + rng.gumbel(size=logs.shape), axis=1)
    large = np.flatnonzero(c > EXACT_CUSTOMERS)
    if len(large):
        t, seated = np.ones(len(large)), np.ones(len(large))
        total = c[large].astype(np.float64)
        while (seated < total).any():
            step = np.minimum(np.maximum(1.0, np.floor(seated / 32)), total - seated)
            opening = (strength + discount * (others[large] + t)) * base[large]
            share = opening / (opening + np.maximum(seated - discount * t, 1e-9))
            t += rng.binomial(step.astype(np.int64), share)
            seated += step
        tables[large] = t.astype(np.int64)
    return tables


def base_of(customers: np.ndarray, tables: np.ndarray, parent: Parent, corpus: Corpus, settings: Settings) -> np.ndarray:
    """The parent's probability of words with so many customers and tables there."""
    d, strength = corpus.parent_discount, settings.parent_strength
    opened = (strength + d * parent.tables) / (corpus.types + 1)
    return (customers - d * tables + opened) / (strength + parent.customers)


def parent_seats(frame: pd.DataFrame, corpus: Corpus, settings: Settings, sweep: int, tables: list[float]):
    """Of a word block: words, counts, and per seating (tables as context, customers, tables as word)."""
    row = frame[frame["kind"] == 0].iloc[0]
    words, counts = unpacked(row["x"], np.uint64) >> np.uint64(16), unpacked(row["y"], np.int64)
    saved = np.zeros((len(tables), 2, len(words)), dtype=np.int64)
    told = frame[frame["kind"] == 2].sort_values("other")
    places = [np.searchsorted(words, unpacked_ids(x)) for x in told["x"]]
    for at, y in zip(places, told["y"]):
        change = unpacked(y, np.int64).reshape(len(tables), 2, len(at))
        saved[:, :, at] += change
    seatings = []
    for number, total in enumerate(tables):
        rng = np.random.default_rng([settings.seed, sweep, number, int(row["block"])])
        customers = counts - saved[number, 1]
        base = np.full(len(words), 1 / (corpus.types + 1))
        others = np.full(len(words), max(total - 1, 0.0))
        own = draw_tables(customers, base, others, settings.parent_strength, corpus.parent_discount, rng)
        seatings.append((counts - saved[number, 0], customers, own))
    return counts, np.array(seatings).reshape(len(tables), 3, len(words)), told, places


def answer_blocks(words: DataFrame, told: DataFrame, corpus: Corpus, settings: Settings, sweep: int, tables: float) -> DataFrame:
    """Per pair block (kind 3), in the order of its words in this word block: the parent's seating."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, seatings, messages, places = parent_seats(frame, corpus, settings, sweep, [tables])
        block = int(frame["block"].iloc[0])
        out = [(4, block, -1, b"", b"", b"", int(seatings[0, 2].sum()), 0, 0)]
        for other, at in zip(messages["other"], places):
            out.append((3, other, block, packed(seatings[0][:, at]), b"", b"", 0, 0, 0))
        return pd.DataFrame(out, columns=SEATED_NAMES)

    mine = words.select("kind", "block", F.lit(-1).cast("bigint").alias("other"), "x", "y")
    theirs = told.select("kind", F.col("other").alias("block"), F.col("block").alias("other"), "x", "y")
    return mine.unionByName(theirs).groupBy("block").applyInPandas(run, SEATED)


def reseat(
    pairs: DataFrame, answers: DataFrame, before: DataFrame | None, corpus: Corpus, settings: Settings, sweep: int,
    parent: Parent, samples: int,
) -> DataFrame:
    """Draw all seatings of every pair block: a row of kind 5 with them, and messages of kind 2."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = next(frame[frame["kind"] == 0].itertuples())
        seats, block = Seats(row), int(row.block)
        got = frame[frame["kind"] == 3].sort_values("other")
        known = [unpacked(x, np.int64).reshape(3, -1) for x in got["x"]]
        context, customers, own = np.concatenate(known, axis=1) if known else np.zeros((3, 0), dtype=np.int64)
        last = frame[frame["kind"] == 5]
        now = unpacked(last["x"].iloc[0], np.int32) if len(last) else np.ones(len(seats.c), dtype=np.int32)
        base = base_of(customers, own, parent, corpus, settings)
        rng = np.random.default_rng([settings.seed, sweep, block])
        drawn = np.array(
            [
                draw_tables(seats.c, base[seats.w], context[seats.u] - now, settings.strength, corpus.discount, rng)
                for _ in range(samples)
            ],
            dtype=np.int32,
        ).reshape(samples, -1)
        saved = (seats.c - drawn).sum(axis=1, dtype=np.int64)
        out = [(5, block, -1, packed(drawn), packed(saved), b"", 0, 0, 0)]
        return pd.DataFrame(out + seats.messages(block, drawn, corpus), columns=SEATED_NAMES)

    rows = pairs.unionByName(answers)
    if before is not None:
        rows = rows.unionByName(before)
    return rows.groupBy("block").applyInPandas(run, SEATED)


def first_messages(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """Messages of the first seating: all customers of a word in a context at one table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                seats = Seats(row)
                tables = np.ones((1, len(seats.c)), dtype=np.int32)
                out = seats.messages(row.block, tables, corpus)
                if out:
                    yield pd.DataFrame(out, columns=SEATED_NAMES)

    return pairs.mapInPandas(run, SEATED)


# ---- answers to the chunks, and scores


def answer_words(words: DataFrame, told: DataFrame, asked: DataFrame, corpus: Corpus, settings: Settings, tables: list[float]) -> DataFrame:
    """Per chunk (kind 6): counts and seatings of its words in this word block, in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts, seatings, _, _ = parent_seats(frame, corpus, settings, settings.sweeps, tables)
        facts = np.concatenate([counts[None], seatings.reshape(-1, len(counts))]).astype(np.int64)
        block = int(frame["block"].iloc[0])
        out = [(4, block, -1, b"", packed(seatings[:, 2].sum(axis=1)), b"", 0, 0, 0)]
        for row in frame[frame["kind"] == 1].itertuples():
            out.append((6, row.other, block, packed(facts[:, unpacked(row.x, np.int32)]), b"", b"", 0, 0, 0))
        return pd.DataFrame(out, columns=SEATED_NAMES)

    mine = words.select("kind", "block", F.lit(-1).cast("bigint").alias("other"), "x", "y")
    theirs = told.select("kind", F.col("other").alias("block"), F.col("block").alias("other"), "x", "y")
    chunks_ = asked.select("kind", "block", F.col("chunk").alias("other"), "x", "y")
    return mine.unionByName(theirs).unionByName(chunks_).groupBy("block").applyInPandas(run, SEATED)


def answer_pairs(pairs: DataFrame, seatings: DataFrame, codes: DataFrame, samples: int) -> DataFrame:
    """Per chunk (kind 7): customers and tables of its pairs in this pair block, in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seats = Seats(next(frame[frame["kind"] == 0].itertuples()))
        drawn = unpacked(frame[frame["kind"] == 5]["x"].iloc[0], np.int32).reshape(samples, -1)
        facts = np.concatenate([np.tile([0, 1], (samples + 1, 1)), np.concatenate([seats.c[None], drawn])], axis=1)
        facts = facts.astype(np.int32)
        block = int(frame["block"].iloc[0])
        out = [
            (7, row.other, block, packed(facts[:, unpacked(row.x, np.uint32)]), b"", b"", 0, 0, 0)
            for row in frame[frame["kind"] == 1].itertuples()
        ]
        return pd.DataFrame(out, columns=SEATED_NAMES)

    return pairs.unionByName(seatings).unionByName(codes).groupBy("block").applyInPandas(run, SEATED)


def score_chunks(table: DataFrame, words: DataFrame, pairs: DataFrame, corpus: Corpus, settings: Settings, parents: list[Parent]) -> DataFrame:
    """Per chunk, arrays over its documents: known tokens, base score and score."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = next(frame[frame["kind"] == 8].itertuples())
        short = unpacked(row.words, np.uint64) >> np.uint64(16)
        tokens, lengths = unpacked(row.tokens, np.int32), np.array(row.lengths)
        u, w, which = pairs_of(tokens, row.ends, len(short))
        facts = np.zeros((1 + 3 * len(parents), len(short)), dtype=np.int64)
        answers = {int(b): x for b, x in zip(frame["other"][frame["kind"] == 6], frame["x"][frame["kind"] == 6])}
        for block, at in cut(spread(short, corpus.word_blocks)):
            facts[:, at] = unpacked(answers[block], np.int64).reshape(len(facts), -1)
        counts = facts[0]
        seen = np.zeros((1 + len(parents), len(u)), dtype=np.int64)
        answers = {int(b): x for b, x in zip(frame["other"][frame["kind"] == 7], frame["x"][frame["kind"] == 7])}
        for block, at in cut(pair_blocks(short, u, w, corpus)):
            seen[:, at] = unpacked(answers[block], np.int32).reshape(len(seen), -1)
        total = np.zeros(len(u))
        size = settings.strength + counts[u]
        for number, parent in enumerate(parents):
            context, customers, own = facts[1 + 3 * number : 4 + 3 * number]
            base = base_of(customers, own, parent, corpus, settings)
            at_tables = seen[0] - corpus.discount * seen[1 + number]
            total += (at_tables + (settings.strength + corpus.discount * context[u]) * base[w]) / size
        logs = np.log10(total / len(parents))
        plain = np.log10((counts + 0.1) / (corpus.tokens + 0.1 * (corpus.types + 1)))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        per_text = lambda values: np.add.reduceat(values, starts).tolist()
        made = [per_text((counts > 0)[tokens].astype(np.int64)), per_text(plain[tokens]), per_text(logs[which])]
        return pd.DataFrame([(int(row.block), *made)], columns=["chunk", "n_known", "base_score", "score"])

    none = F.lit(None).cast("binary")
    mine = table.select(
        F.lit(8).alias("kind"), F.col("chunk").alias("block"), F.lit(-1).cast("bigint").alias("other"), none.alias("x"),
        "lengths", "ends", "words", "tokens",
    )
    theirs = words.unionByName(pairs).select("kind", "block", "other", "x")
    rows = mine.unionByName(theirs, allowMissingColumns=True)
    return rows.groupBy("block").applyInPandas(
        run, "chunk bigint, n_known array<bigint>, base_score array<double>, score array<double>"
    )


def _discount(ones: int, twos: int) -> float:
    """The share that leaves as many pairs unseen as were seen once: n1 / (n1 + 2 n2)."""
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.1, 0.95))


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held`` marks the rows not to learn from; by default those whose CRC-32 of the id is a multiple of 10.
    """
    if held is None:
        held = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 10 == 0
    table = stage(chunks(docs, id_col, text_col, held), "chunks")
    sums = table.agg(F.sum("n_all").alias("all"), F.sum("n_train").alias("train")).first()
    n_all, n_train = sums["all"] or 0, sums["train"] or 0
    blocks = max(16, n_all // TOKENS_PER_BLOCK)
    word_blocks = max(16, blocks // 2)

    words = stage(word_totals(ask_words(table, word_blocks), max(50.0, n_train / (4 * blocks))), "words")
    mine, asked = words.where("kind = 0"), words.where("kind = 1")
    known = mine.agg(F.sum("types").alias("types"), F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    hot = np.array([row[0] for row in mine.select(F.explode("hot")).collect()], dtype=np.uint64)
    corpus = Corpus(n_train, known["types"] or 0, blocks, word_blocks, hot, parent_discount=_discount(known["ones"] or 0, known["twos"] or 0))

    seated = stage(pair_totals(ask_pairs(table, corpus), corpus), "pairs")
    pairs, codes = seated.where("kind = 0"), seated.where("kind = 1")
    totals = pairs.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    corpus = Corpus(**{**corpus.__dict__, "discount": _discount(totals["ones"] or 0, totals["twos"] or 0)})

    told, before, state, tables = first_messages(pairs, corpus), None, None, float(corpus.types)
    customers = float(_first_customers(pairs))
    for sweep in range(settings.sweeps):
        samples = settings.samples if sweep == settings.sweeps - 1 else 1
        answers = stage(answer_blocks(mine, told, corpus, settings, sweep, tables), "answers")
        tables = float(answers.where("kind = 4").agg(F.sum("n")).first()[0] or 0)
        last, state = state, stage(
            reseat(pairs, answers.where("kind = 3"), before, corpus, settings, sweep, Parent(customers, tables), samples),
            "seats",
        )
        unstage(answers, *([last] if last is not None else []))
        told, before = state.where("kind = 2"), state.where("kind = 5")
        saved = _summed(before, "y", samples)
        customers = n_train - saved[0]
    to_chunks = stage(answer_words(mine, told, asked, corpus, settings, [tables] * settings.samples), "facts")
    opened = _summed(to_chunks.where("kind = 4"), "y", settings.samples)
    parents = [Parent(n_train - s, t) for s, t in zip(saved, opened)]
    seen = stage(answer_pairs(pairs, before, codes, settings.samples), "seen")
    unstage(words, seated, state)
    scored = score_chunks(table, to_chunks.where("kind = 6"), seen, corpus, settings, parents)
    rows = table.select("chunk", "ids", "held", "lengths").join(scored, "chunk")
    rows = rows.select(F.inline(F.arrays_zip("ids", "held", "lengths", "n_known", "base_score", "score")))
    n = F.col("lengths").cast("bigint")
    return rows.select(
        F.col("ids").alias(id_col), F.col("held").alias("held_out"), n.alias("n_tokens"), "n_known",
        F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / n).alias("perplexity"),
    )


def _first_customers(pairs: DataFrame) -> int:
    """Customers of the parent in the first seating: one per pair that occurs."""
    row = pairs.agg(F.sum("n").alias("seated"), F.sum("ones").alias("ones")).first()
    return (row["seated"] or 0) + (row["ones"] or 0)


def _summed(rows: DataFrame, column: str, samples: int) -> list[int]:
    """Sum of short packed lists, one number per sample; each list is the summary of one block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [unpacked(data, np.int64).tolist() for data in frame[column]]
            yield pd.DataFrame({"n": lists})

    lists = rows.select(column).mapInPandas(run, "n array<bigint>")
    row = lists.agg(*[F.sum(F.col("n")[i]).alias(str(i)) for i in range(samples)]).first()
    return [int(value or 0) for value in row]
