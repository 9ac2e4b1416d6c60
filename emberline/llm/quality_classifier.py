"""A quality classifier that learns from weak labels.

Several heuristic labellers look at overlapping traits of a text and vote or abstain. The label model
(``weak_labels``) estimates by expectation-maximisation how far each can be trusted, over all
documents. The posterior labels of a bounded sample then train a linear scorer over hashed words, word
shapes and coarse traits, and the scorer judges every document, also those on which the labellers
abstained.

The sample is the one thing that doesn't grow with the input: ``sample_rows`` documents, those with
the smallest hash of id and text. Everything else covers all rows.

Defined cases: a null text is an empty one; an empty text has no features, gets the prior as its
score and is not kept; repeated rows get equal scores; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import weak_labels
from emberline.llm.frames import per_text, utf8
from emberline.llm.text_stats import TextStats, text_stats
from emberline.llm.weak_labels import ABSTAIN, BAD, GOOD

SAMPLE_ROWS = 6_000
BITS = 15
MIN_SCORE = 0.5
N_LABELLERS = 8
SHAPE = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9")]


def labels(stats: TextStats) -> list[int]:
    """The votes of the labellers; several look at the same trait from another side."""
    if stats.n_words < 5:
        return [ABSTAIN] * N_LABELLERS
    words, signs = stats.n_words, max(stats.word_chars, 1)
    symbols, letters = stats.n_symbols / signs, stats.n_letters / signs
    upper, shouts = stats.n_upper / max(stats.n_letters, 1), stats.n_shouts / words
    repeats, top = stats.n_repeat_words / words, stats.top_word / words
    copies = stats.n_dup_lines / max(stats.n_lines, 1)
    length = stats.word_chars / words
    return [
        BAD if symbols > 0.08 else GOOD if symbols < 0.01 else ABSTAIN,
        BAD if letters < 0.65 else GOOD if letters > 0.8 else ABSTAIN,
        BAD if upper > 0.5 else GOOD if upper < 0.2 else ABSTAIN,
        BAD if shouts > 0.2 else GOOD if shouts < 0.05 else ABSTAIN,
        BAD if repeats > 0.5 else GOOD if repeats < 0.15 else ABSTAIN,
        BAD if copies > 0.5 else GOOD if copies < 0.2 and stats.n_lines > 2 else ABSTAIN,
        BAD if stats.n_bare / words > 0.2 else GOOD if stats.n_bare == 0 else ABSTAIN,
        BAD if length < 2 or length > 15 or (top > 0.4 and words > 20) else GOOD if 3 < length < 9 else ABSTAIN,
    ]


def shape(word: bytes) -> bytes:
    """What a word looks like: runs of small letters, capitals and digits, and its marks."""
    for runs, sign in SHAPE:
        word = runs.sub(sign, word)
    return word[:12]


def features(text: str, stats: TextStats, shapes: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places and weights: words and shapes by damped frequency, then traits in steps."""
    words = Counter(utf8(text).split())
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    total = stats.n_words
    seen: Counter[bytes] = Counter()
    for word, count in words.items():
        look = shapes.get(word)
        if look is None:
            if len(shapes) > 200_000:
                shapes.clear()
            look = shapes[word] = shape(word)
        seen[look] += count
    crc = zlib.crc32
    places = [crc(b"w" + word) for word in words] + [crc(b"s" + look) for look in seen]
    damped = [math.sqrt(count / total) for count in words.values()]
    values = [0.5 * value for value in damped] + [math.sqrt(count / total) for count in seen.values()]
    traits = {
        b"symbols": stats.n_symbols / total, b"upper": stats.n_upper / max(stats.n_letters, 1),
        b"repeats": stats.n_repeat_words / total, b"copies": stats.n_dup_lines / max(stats.n_lines, 1),
        b"bare": stats.n_bare / total, b"shouts": stats.n_shouts / total, b"top": stats.top_word / total,
        b"letters": stats.n_letters / max(stats.word_chars, 1),
    }
    for name, value in traits.items():
        places.append(crc(b"t" + name + b"%d" % min(10, int(value * 10))))
        values.append(1.0)
    return np.array(places, dtype=np.int64) & ((1 << BITS) - 1), np.array(values)


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        margin = float(self.weights[places] @ values) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, rate: float = 0.2) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps, in the order of the rows."""
    weights = np.zeros(1 << BITS)
    squares = np.full(1 << BITS, 1e-2)
    share = float(np.clip(np.mean([row[2] for row in rows]), 0.01, 0.99)) if rows else 0.5
    bias = math.log(share / (1 - share))
    for _ in range(epochs):
        for places, values, label in rows:
            margin = float(weights[places] @ values) + bias
            slope = 1 / (1 + math.exp(-max(-500.0, min(500.0, margin)))) - label
            if abs(slope) < 1e-4:
                continue
            gradient = slope * values + 1e-5 * weights[places]
            squares[places] += gradient * gradient
            weights[places] -= rate * gradient / np.sqrt(squares[places])
    return Scorer(weights, bias)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> tuple[weak_labels.LabelModel, Scorer]:
    """The label model over all documents, and the scorer trained on the sample's posteriors."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    votes = per_text(docs, id_col, text_col, "votes bigint", lambda: lambda t: (weak_labels.pattern(labels(text_stats(t))),))
    counts = votes.groupBy("votes").count().collect()
    codes = sorted((row["votes"], row["count"]) for row in counts)
    model = weak_labels.fit_patterns(
        np.array([c for c, _ in codes], dtype=np.int64), np.array([n for _, n in codes]), N_LABELLERS
    )
    total = sum(n for _, n in codes)
    hashed = docs.select(F.xxhash64(id_, text).alias("_hash"), text.alias("_text"))
    # a margin over the share keeps the order below it cheap; the smallest hashes are taken exactly
    share = min(1.0, (sample_rows + 4 * math.sqrt(sample_rows) + 10) / max(total, 1))
    limit = int(-(2**63) + share * (2**64 - 1))
    near = hashed.where(F.col("_hash") <= min(limit, 2**63 - 1))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes: dict[bytes, bytes] = {}
        for frame in frames:
            rows = []
            for key, text in zip(frame["_hash"], frame["_text"]):
                stats = text_stats(text or "")
                places, values = features(text or "", stats, shapes)
                label = model.posterior_good(np.array([labels(stats)]))[0]
                rows.append((key, places.astype(np.int32).tobytes(), values.astype(np.float32).tobytes(), float(label)))
            yield pd.DataFrame(rows, columns=["key", "places", "weights", "label"])

    sample = near.mapInPandas(made, "key bigint, places binary, weights binary, label double")
    taken = sample.orderBy("key").limit(sample_rows).collect()
    rows = [
        (np.frombuffer(r["places"], np.int32).astype(np.int64), np.frombuffer(r["weights"], np.float32).astype(float), r["label"])
        for r in taken
    ]
    return model, train(rows)


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
    fitted: tuple[weak_labels.LabelModel, Scorer] | None = None,
) -> DataFrame:
    """Per row: the id, ``label`` (the labellers' posterior of good), ``score`` and ``kept``."""
    model, scorer = fitted or fit(docs, id_col, text_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def one():
        label_model, linear = shared.value
        shapes: dict[bytes, bytes] = {}

        def judge(text: str) -> tuple:
            stats = text_stats(text)
            score = linear.score(*features(text, stats, shapes))
            label = float(label_model.posterior_good(np.array([labels(stats)]))[0])
            return label, score, bool(stats.n_words and score >= MIN_SCORE)

        return judge

    return per_text(docs, id_col, text_col, "label double, score double, kept boolean", one)
