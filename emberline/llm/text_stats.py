"""Counts of one text that rules about its quality use."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np

from emberline.llm.frames import utf8

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
BEYOND = bytes(range(128, 256))
MARKS = bytes(code for code in range(33, 127) if not chr(code).isalnum())


class TextStats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int
    n_letters: int
    n_bare: int
    n_shouts: int
    top_word: int


STATS_SCHEMA = ", ".join(f"{name} bigint" for name in TextStats._fields)


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words as numbers in order of first sight, and the distinct words in that order."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), list(seen)


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words which the text holds at least twice."""
    if len(ids) < 4:
        return 0
    size = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def text_stats(text: str) -> TextStats:
    """All counts of a whole text; an empty text has zeros throughout.

    Words are runs of anything but ASCII blanks. A bare word has no letter or digit; a shout is a
    doubled exclamation mark. All code points beyond ASCII count as lower-case letters.
    """
    raw = utf8(text)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    beyond = len(text) - len(raw.translate(None, BEYOND))
    ids, distinct = numbered(words)
    uses = np.bincount(ids, minlength=len(distinct)) if words else np.zeros(0, dtype=np.int64)
    return TextStats(
        n_words=len(words),
        word_chars=len(text) - blanks,
        n_symbols=len(raw) - len(raw.translate(None, SYMBOLS)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeat_words(ids),
        n_lines=len(lines),
        n_upper=len(raw) - len(raw.translate(None, UPPER)),
        n_letters=len(raw) - len(raw.translate(None, UPPER + LOWER)) + beyond,
        n_bare=int(sum(uses[i] for i, word in enumerate(distinct) if not word.translate(None, MARKS))),
        n_shouts=raw.count(b"!!"),
        top_word=int(uses.max()) if words else 0,
    )
