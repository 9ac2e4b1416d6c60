"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

A text is split by the tokenizer's pattern; each distinct piece is encoded once while it stays in a
bounded table. New pieces go into padded matrices, one per bucket of similar lengths. Each round,
every row looks for its leftmost pair of minimum rank (``argmin`` over the matrix of pair ranks),
merges it, and closes the gap by shifting its tail; rows without a mergeable pair leave the matrix.
Ranks of pairs come from one hash table in two numpy arrays, probed for a whole column at a time.

Ranks are data of the tokenizer, read from a file that every executor has, by its path.

Defined cases: a null text is an empty one; an empty text has no tokens and decodes to nothing; texts
and pieces of any length are encoded whole; repeated rows are encoded as often as they occur in the
result; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from emberline.llm.frames import per_batch

NONE = np.int32(2**31 - 1)
LONG_PIECE = 128
CACHED_UNITS = 600_000
# Fixed value: where matches of the pattern of byte_bpe vocabularies must begin and end, runs of
# anything but white space with the blank before them, and runs of white space.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
BATCH_CHARS = 4_000_000


class PairTable:
    """Rank of the merge of two tokens, by open addressing over packed pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = self.keys[slot[waiting]] == -1
            first = np.unique(slot[waiting][free], return_index=True)[1]
            placed = waiting[free][first]
            self.keys[slot[placed]] = keys[placed]
            self.values[slot[placed]] = merged[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged token per pair, NONE where the pair doesn't merge or one side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        flat = np.full(keys.size, NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[at]
        slot = self._slot(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(left.shape)


@dataclass(frozen=True)
class Tokenizer:
    pairs: PairTable
    byte_ids: np.ndarray
    tokens: list[bytes]
    blob: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    pattern: regex.Pattern


def build(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """Tables for ranks: every way to split a token into two tokens is a pair that merges to it."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            head, tail = ranks.get(token[:cut]), ranks.get(token[cut:])
            if head is not None and tail is not None:
                left.append(head), right.append(tail), merged.append(rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(token) for token in tokens], dtype=np.int64)
    return Tokenizer(
        PairTable(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(merged, dtype=np.int64)),
        np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32),
        tokens,
        np.frombuffer(b"".join(tokens), dtype=np.uint8),
        np.concatenate([[0], np.cumsum(lengths)[:-1]]),
        lengths,
        regex.compile(pattern),
    )


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Tokenizer:
    """Read ranks (base64 token and number per line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return build(ranks, pattern)


def merge_matrix(tokenizer: Tokenizer, pieces: list[bytes]) -> list[bytes]:
    """Token ids per piece, as packed 32-bit numbers, for pieces of similar length."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(lengths.max())
    ids = np.full((len(pieces), width + 1), -1, dtype=np.int32)
    inside = np.arange(width + 1) < lengths[:, None]
    ids[inside] = tokenizer.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    ranks = tokenizer.pairs.rank(ids[:, :-1], ids[:, 1:])
    rows, finished, found = np.arange(len(pieces)), [], []
    while len(rows):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        keep = best != NONE
        if not keep.all():
            finished.append(rows[~keep])
            done = ids[~keep]
            ends = 4 * np.cumsum((done >= 0).sum(axis=1))
            flat = done[done >= 0].tobytes()
            found += [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
            rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
            if not len(rows):
                break
        # close the gap: one place less for every row
        column = np.arange(ids.shape[1] - 1)
        ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
        line = np.arange(len(rows))
        ids[line, at] = best
        ranks = np.where(column[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
        # only the pairs on either side of the merged place are new; at the ends one side is padding
        right = np.flatnonzero(at < ranks.shape[1])
        ranks[right, at[right]] = tokenizer.pairs.rank(ids[right, at[right]], ids[right, at[right] + 1])
        left = np.flatnonzero(at > 0)
        ranks[left, at[left] - 1] = tokenizer.pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])
        if not ranks.shape[1]:
            ranks = np.full((len(rows), 1), NONE, dtype=np.int32)
    out: list[bytes] = [b""] * len(pieces)
    for row, made in zip(np.concatenate(finished).tolist(), found):
        out[row] = made
    return out


def merge_long(tokenizer: Tokenizer, piece: bytes) -> bytes:
    """The same for one long piece: a matrix of one row whose gaps are closed now and then.

    Merged places are marked and skipped through links, so a round costs one ``argmin`` instead of a
    shift of the whole tail; when half of the places are gone the row is compacted.
    """
    ids = tokenizer.byte_ids[np.frombuffer(piece, dtype=np.uint8)].copy()
    while True:
        size = len(ids)
        ranks = np.full(size, NONE, dtype=np.int32)
        ranks[:-1] = tokenizer.pairs.rank(ids[:-1], ids[1:])
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        alive, gone = np.ones(size, dtype=bool), 0
        while True:
            at = int(ranks.argmin())
            if ranks[at] == NONE:
                return ids[alive].tobytes()
            ids[at] = ranks[at]
            dead = int(after[at])
            alive[dead], ranks[dead], gone = False, NONE, gone + 1
            following, previous = int(after[dead]), int(before[at])
            after[at] = following
            if following < size:
                before[following] = at
            ranks[at] = tokenizer.pairs.rank(ids[[at]], ids[[following]])[0] if following < size else NONE
            if previous >= 0:
                ranks[previous] = tokenizer.pairs.rank(ids[[previous]], ids[[at]])[0]
            if gone * 2 > size:
                ids = ids[alive]
                break


def encode_pieces(tokenizer: Tokenizer, pieces: list[bytes], cells: int = 400_000) -> list[bytes]:
    """Packed token ids of distinct pieces; a matrix holds about ``cells`` places or one row."""
    out: list[bytes] = [b""] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    start = 0
    while start < len(order):
        size = len(pieces[order[start]])
        if size > LONG_PIECE:
            out[order[start]] = merge_long(tokenizer, pieces[order[start]])
            start += 1
            continue
        end, widest = start, min(max(size + 2, size * 5 // 4), LONG_PIECE)
        while end < len(order) and len(pieces[order[end]]) <= widest and (end - start) * widest < cells:
            end += 1
        bucket = order[start:end]
        for i, ids in zip(bucket, merge_matrix(tokenizer, [pieces[i] for i in bucket])):
            out[i] = ids
        start = end
    return out


class Encoder:
    """Encodes texts batch by batch; units seen before come from a table of bounded size.

    A unit is a stretch of text that no match of the pattern crosses, by default a match itself.
    """

    def __init__(self, tokenizer: Tokenizer, units: str | None = None, cached: int = CACHED_UNITS):
        self.tokenizer, self.cached = tokenizer, cached
        self.units = re.compile(units) if units else tokenizer.pattern
        self.known: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet, each distinct piece of them once."""
        split = [self.tokenizer.pattern.findall(unit) for unit in units]
        pieces = list({piece for parts in split for piece in parts})
        ids = dict(zip(pieces, encode_pieces(self.tokenizer, [piece.encode("utf-8", "replace") for piece in pieces])))
        for unit, parts in zip(units, split):
            self.known[unit] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[part] for part in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.units.findall(text) for text in texts]
        if len(self.known) > self.cached:
            self.known.clear()
        fresh = {unit for units in split for unit in units}.difference(self.known)
        if fresh:
            self.learn(fresh)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, units)), dtype=np.int32) for units in split]


def decode(tokenizer: Tokenizer, ids: np.ndarray) -> bytes:
    """The bytes of a sequence of ids, gathered from one array of all tokens."""
    if not len(ids):
        return b""
    lengths = tokenizer.lengths[ids]
    ends = np.cumsum(lengths)
    shift = tokenizer.starts[ids] - (ends - lengths)
    return tokenizer.blob[np.repeat(shift, lengths) + np.arange(int(ends[-1]))].tobytes()


def batches_of(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts with about ``chars`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > chars:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", units: str | None = None
) -> DataFrame:
    """Per row: the id, the token ids in ``ids`` and the decoded bytes in ``decoded``."""

    def compute():
        encoder = Encoder(load(path, pattern), units)

        def rows(texts: list[str]) -> Iterator[list[tuple]]:
            for run in batches_of(texts):
                yield [(ids.tolist(), decode(encoder.tokenizer, ids)) for ids in encoder.encode(run)]

        return rows

    return per_batch(docs, id_col, text_col, "ids array<int>, decoded binary", compute)


def digest_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", units: str | None = None
) -> DataFrame:
    """Per row: the id, ``n_tokens`` and digests of the ids and of the decoded bytes.

    The ids and bytes are those of ``encode_documents``; they are hashed in the task that made them.
    """

    def compute():
        encoder = Encoder(load(path, pattern), units)
        names = [str(rank) for rank in range(len(encoder.tokenizer.tokens))]

        def row(ids: np.ndarray) -> tuple:
            shown = ",".join(map(names.__getitem__, ids.tolist()))
            back = decode(encoder.tokenizer, ids)
            return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

        def rows(texts: list[str]) -> Iterator[list[tuple]]:
            for run in batches_of(texts):
                yield [row(ids) for ids in encoder.encode(run)]

        return rows

    return per_batch(docs, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", compute)
