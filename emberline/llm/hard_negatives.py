"""Hard negatives by segment summaries.

A vector is cut into segments, and the mean m and the standard deviation d of each are stored with it.
Over a segment of length l the inner product of two vectors lies within ``l * (m*m' +- d*d')``: the
deviations from the means are vectors of length ``sqrt(l) * d``. So two short vectors of summaries bound
the score of a pair. The search starts with one segment, the whole vector, keeps the pairs whose bounds
still allow a place among those asked for, looks at those with ever shorter segments, and scores what
is left exactly, with integers.

Two searches run, each of all anchors against all rows in blocks: first the best rows of an anchor's
own label, its positives; then, for each positive, the best rows of other labels that score between
``low`` and ``high`` percent of it. Rows are packed into blocks with their summaries where they are read.
A task gets about ``ROWS`` rows and ``ANCHORS`` anchors and returns at most what is asked for per
anchor; a window merges the tasks' answers. The work is that of anchors times rows, as asked; a row is
shuffled once per ``ANCHORS`` anchors and an anchor once per ``ROWS`` rows.

Defined cases: a row takes part if it has an id, a label and a vector without a null or non-finite
component; a vector shorter than the longest is filled with zeros, so an empty one scores zero; rows
that repeat an id are rows of their own, and none is a positive of another with its id; equal scores are
ordered by id; an empty table, or one without anchors, gives an empty result; other columns are not
read. Scores are 64-bit integers, and so must be the sums they are made of.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import stage

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
ROWS, ANCHORS = 16_384, 8_192
PACKED = 2_048
CHUNK = 64
FINEST = 16
LEVELS = (1, 4, 16)
DENSE = 1 / 16
GATHER = 1 << 16


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components as integers: the floor of ``scale`` times each. Null if one is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


# ---- summaries


def bounds_of(width: int, segments: int) -> np.ndarray:
    """Where the segments of a vector begin; no segment is empty unless the vector is."""
    return np.unique(np.arange(segments) * width // segments) if width else np.zeros(0, dtype=np.int64)


def summaries(codes: np.ndarray, segments: int = FINEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, means, deviations) of the finest segments of each row."""
    starts = bounds_of(codes.shape[1], segments)
    if not len(starts):
        return np.zeros(0), np.zeros((len(codes), 0)), np.zeros((len(codes), 0))
    lengths = np.diff(np.append(starts, codes.shape[1])).astype(np.float64)
    values = codes.astype(np.float64)
    means = np.add.reduceat(values, starts, axis=1) / lengths
    gaps = values - np.repeat(means, lengths.astype(int), axis=1)
    return lengths, means, np.sqrt(np.add.reduceat(gaps * gaps, starts, axis=1) / lengths)


def coarser(lengths: np.ndarray, means: np.ndarray, deviations: np.ndarray, segments: int):
    """The summaries of longer segments, from those of the shorter ones they are made of."""
    starts = bounds_of(len(lengths), segments)
    if not len(starts):
        return lengths, means, deviations
    whole = np.add.reduceat(lengths, starts)
    mean = np.add.reduceat(means * lengths, starts, axis=1) / whole
    square = np.add.reduceat((deviations**2 + means**2) * lengths, starts, axis=1) / whole
    return whole, mean, np.sqrt(np.maximum(square - mean**2, 0))


class Vectors:
    """Vectors of one side of a search with their summaries at every level."""

    def __init__(self, codes: np.ndarray, finest: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.codes = codes
        self.levels = []
        for segments in LEVELS:
            lengths, means, deviations = coarser(*finest, segments)
            root = np.sqrt(lengths)
            self.levels.append((means * root, deviations * root))
        self.norms = np.sqrt((codes.astype(np.float64) ** 2).sum(axis=1))
        largest = float(np.abs(codes).max()) if codes.size else 0.0
        self.exact_in_doubles = largest**2 * codes.shape[1] < 2.0**52
        self.doubles = codes.astype(np.float64) if self.exact_in_doubles else None

    def take(self, places: slice) -> "Vectors":
        part = object.__new__(Vectors)
        part.codes, part.norms, part.exact_in_doubles = self.codes[places], self.norms[places], self.exact_in_doubles
        part.levels = [(means[places], deviations[places]) for means, deviations in self.levels]
        part.doubles = None if self.doubles is None else self.doubles[places]
        return part


def _products(a: np.ndarray, b: np.ndarray, alive: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Inner products of all rows, or of the pairs named."""
    if alive is None:
        return a @ b.T
    made = np.empty(len(alive[0]), dtype=np.result_type(a, b))
    for start in range(0, len(made), GATHER):
        cut = slice(start, start + GATHER)
        made[cut] = np.einsum("ij,ij->i", a[alive[0][cut]], b[alive[1][cut]])
    return made


def bracket(a: Vectors, b: Vectors, level: int, alive: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of scores at a level, with room for the rounding of the summaries."""
    middle = _products(a.levels[level][0], b.levels[level][0], alive)
    reach = _products(a.levels[level][1], b.levels[level][1], alive)
    norms = np.outer(a.norms, b.norms) if alive is None else a.norms[alive[0]] * b.norms[alive[1]]
    reach = reach + 1e-9 * norms + 1e-6
    return middle - reach, middle + reach


def scores(a: Vectors, b: Vectors, alive: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact scores of the pairs named."""
    if a.exact_in_doubles and b.exact_in_doubles and len(a.codes) and len(b.codes):
        if len(alive[0]) > DENSE * len(a.codes) * len(b.codes):
            return np.rint((a.doubles @ b.doubles.T)[alive]).astype(np.int64)
        return np.rint(_products(a.doubles, b.doubles, alive)).astype(np.int64)
    return _products(a.codes.astype(np.int64), b.codes.astype(np.int64), alive)


def survivors(a: Vectors, b: Vectors, eligible: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are left when the bounds of every level have been looked at.

    ``keep`` says, from matrices of lower and upper bounds, which cells may still be wanted; cells that
    are not eligible have the bounds infinity and minus infinity.
    """
    lower = np.where(eligible, -np.inf, np.inf)
    upper = -lower
    open_ = eligible
    for level in range(len(LEVELS)):
        if open_.sum() > DENSE * open_.size:
            low, high = bracket(a, b, level, None)
            np.maximum(lower, low, out=lower, where=open_)
            np.minimum(upper, high, out=upper, where=open_)
        else:
            alive = np.nonzero(open_)
            low, high = bracket(a, b, level, alive)
            lower[alive] = np.maximum(lower[alive], low)
            upper[alive] = np.minimum(upper[alive], high)
        open_ = open_ & keep(lower, upper, open_)
        lower[~open_], upper[~open_] = np.inf, -np.inf
    return np.nonzero(open_)


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Per row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by falling score, then rising id."""
    order = np.lexsort([ids, -score, group])
    sorted_ = group[order]
    opens = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(opens, np.diff(np.append(opens, len(order))))
    return order[rank < k]


# ---- blocks


BLOCK = "n int, ids binary, labels binary, codes binary, kind string, lengths binary, means binary, deviations binary"


def packed(vectors: DataFrame, width: int) -> DataFrame:
    """Rows (id, label, codes) in blocks, with the summaries of their finest segments."""

    def block(ids: list[int], labels: list[int], codes: list[list[int]]) -> pa.RecordBatch:
        matrix = np.zeros((len(ids), width), dtype=np.int64)
        for place, row in enumerate(codes):
            matrix[place, : len(row)] = row
        lengths, means, deviations = summaries(matrix)
        kind = np.int16 if not matrix.size or np.abs(matrix).max() < 2**15 else np.int64
        values = [
            len(ids), np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), matrix.astype(kind).tobytes(),
            np.dtype(kind).name, lengths.tobytes(), means.tobytes(), deviations.tobytes(),
        ]
        names = [field.split()[0] for field in BLOCK.split(", ")]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([value], type_) for value, type_ in zip(values, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED):
                part = batch.slice(start, PACKED)
                for values, name in zip(held, ("id", "label", "codes")):
                    values += part.column(name).to_pylist()
                if len(held[0]) >= PACKED:
                    yield block(*held)
                    held = [[], [], []]
        if held[0]:
            yield block(*held)

    return vectors.select("id", "label", "codes").mapInArrow(run, BLOCK)


def unpacked(blocks: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, Vectors]:
    """(ids, labels, vectors) of several blocks."""
    parts = {name: [] for name in ("ids", "labels", "codes", "means", "deviations")}
    lengths = np.zeros(0)
    for row in blocks.itertuples(index=False):
        parts["ids"].append(np.frombuffer(row.ids, np.int64))
        parts["labels"].append(np.frombuffer(row.labels, np.int64))
        parts["codes"].append(np.frombuffer(row.codes, np.dtype(row.kind)).reshape(row.n, width))
        lengths = np.frombuffer(row.lengths)
        for name, raw in (("means", row.means), ("deviations", row.deviations)):
            parts[name].append(np.frombuffer(raw).reshape(row.n, len(lengths)))
    ids, labels, codes, means, deviations = (np.concatenate(values) for values in parts.values())
    return ids, labels, Vectors(codes, (lengths, means, deviations))


def searched(anchors: DataFrame, blocks: DataFrame, sizes: tuple[int, int, int], look, schema: str) -> DataFrame:
    """``look`` applied to all anchors and all rows, in blocks of both.

    ``look(frame of anchors, their vectors, ids, labels, vectors of rows)`` yields frames of ``schema``.
    """
    width, n_rows, n_anchors = sizes
    by_rows, by_anchors = max(1, math.ceil(n_rows / ROWS)), max(1, math.ceil(n_anchors / ANCHORS))
    rows = blocks.select("*", F.pmod(F.xxhash64("ids"), by_rows).cast("int").alias("r"))
    rows = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(by_anchors - 1))))
    asked = anchors.select("*", F.pmod(F.xxhash64("slot"), by_anchors).cast("int").alias("a"))
    asked = asked.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(by_rows - 1))))
    empty = pd.DataFrame({field.split()[0]: pd.Series(dtype="int64") for field in schema.split(", ")})

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty
        ids, labels, vectors = unpacked(right, width)
        codes = np.zeros((len(left), width), dtype=np.int64)
        for place, row in enumerate(left["codes"]):
            codes[place, : len(row)] = row
        own = Vectors(codes, summaries(codes))
        made = []
        for start in range(0, len(left), CHUNK):
            cut = slice(start, start + CHUNK)
            made.append(look(left.iloc[cut], own.take(cut), ids, labels, vectors))
        return pd.concat(made, ignore_index=True)

    return asked.groupBy("r", "a").cogroup(rows.groupBy("r", "a")).applyInPandas(one, schema)


FOUND = "slot bigint, positive_id bigint, positive_score bigint"


def _look_for_positives(k: int):
    def look(asked: pd.DataFrame, own: Vectors, ids: np.ndarray, labels: np.ndarray, rows: Vectors) -> pd.DataFrame:
        anchor_ids = asked["id"].to_numpy()
        same = asked["label"].to_numpy()[:, None] == labels[None, :]
        eligible = same & (anchor_ids[:, None] != ids[None, :])

        def keep(lower: np.ndarray, upper: np.ndarray, open_: np.ndarray) -> np.ndarray:
            return upper >= kth_largest(np.where(open_, lower, -np.inf), k)[:, None]

        alive = survivors(own, rows, eligible, keep)
        score = scores(own, rows, alive)
        first = best(alive[0], score, ids[alive[1]], k)
        return pd.DataFrame({
            "slot": asked["slot"].to_numpy()[alive[0][first]], "positive_id": ids[alive[1][first]], "positive_score": score[first],
        })

    return look


MINED = "slot bigint, place bigint, negative_id bigint, negative_score bigint"


def _look_for_negatives(k: int, low: int, high: int):
    def look(asked: pd.DataFrame, own: Vectors, ids: np.ndarray, labels: np.ndarray, rows: Vectors) -> pd.DataFrame:
        eligible = asked["label"].to_numpy()[:, None] != labels[None, :]
        given = [np.asarray(row, dtype=np.int64) for row in asked["positives"]]
        most = max(map(len, given))
        limits = [
            (np.array([low * row[p] / 100 if p < len(row) else np.inf for row in given]),
             np.array([high * row[p] / 100 if p < len(row) else -np.inf for row in given]))
            for p in range(most)
        ]

        def keep(lower: np.ndarray, upper: np.ndarray, open_: np.ndarray) -> np.ndarray:
            wanted = np.zeros(lower.shape, dtype=bool)
            for least, greatest in limits:
                room = 1e-6 + 1e-9 * (np.abs(least) + np.abs(greatest))
                room = np.where(np.isfinite(room), room, 0)
                floor, roof = (least - room)[:, None], (greatest + room)[:, None]
                inside = open_ & (lower >= (least + room)[:, None]) & (upper <= (greatest - room)[:, None])
                floor = np.maximum(floor, kth_largest(np.where(inside, lower, -np.inf), k)[:, None])
                wanted |= (upper >= floor) & (lower <= roof)
            return wanted

        alive = survivors(own, rows, eligible, keep)
        score = scores(own, rows, alive)
        found = []
        for p in range(most):
            has = np.array([p < len(row) for row in given])
            goal = np.array([row[p] if p < len(row) else 0 for row in given])[alive[0]]
            fits = np.flatnonzero(has[alive[0]] & (low * goal <= 100 * score) & (100 * score <= high * goal))
            first = fits[best(alive[0][fits], score[fits], ids[alive[1][fits]], k)]
            found.append(pd.DataFrame({
                "slot": asked["slot"].to_numpy()[alive[0][first]], "place": np.full(len(first), p),
                "negative_id": ids[alive[1][first]], "negative_score": score[first],
            }))
        return pd.concat(found, ignore_index=True)

    return look


def mine(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    ``vectors`` has columns id and label, and codes: arrays of integers, null where a row takes no part.
    """
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("codes").isNotNull()
    rows = stage(
        vectors.where(whole).select(
            F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "codes",
            F.coalesce(anchor, F.lit(False)).alias("anchor"),
        ),
        "vectors",
    )
    width, n_rows, n_anchors = rows.agg(
        F.coalesce(F.max(F.size("codes")), F.lit(0)), F.count("*"), F.count_if("anchor")
    ).first()
    sizes = (width, n_rows, n_anchors)
    blocks = stage(packed(rows, width), "blocks")
    asked = stage(rows.where("anchor").select(F.monotonically_increasing_id().alias("slot"), "id", "label", "codes"), "anchors")

    near = searched(asked, blocks, sizes, _look_for_positives(positives), FOUND)
    order = Window.partitionBy("slot").orderBy(F.desc("positive_score"), "positive_id")
    near = stage(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives), "positives")
    listed = near.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    listed = listed.select("slot", F.col("p.positive_score").alias("positives"))

    far = searched(asked.join(listed, "slot"), blocks, sizes, _look_for_negatives(negatives, low, high), MINED)
    order = Window.partitionBy("slot", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = near.join(asked.select("slot", F.col("id").alias("anchor_id")), "slot")
    return named.join(far.withColumn("place", F.col("place").cast("int")), ["slot", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
