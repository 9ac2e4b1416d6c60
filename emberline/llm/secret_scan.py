"""Secrets, found by form and by how many guesses a value in a credential context would take.

Plain findings (``base_spans``) are matches of three fixed forms. Beyond them, whatever stands where a
password, key or token is expected is priced: a dynamic program finds the cheapest way to put the
value together from dictionary words, dates, repeated characters, keyboard walks, runs of the alphabet
and brute force, in powers of ten. Placeholders and ordinary words are cheap; what stays expensive
however it is cut is a secret. The dictionary is learnt from the corpus: a word costs its rank. Values
after "bearer", "is" or a sign of assignment are not learnt from, or a secret of letters would teach itself.

Defined cases: a null text is an empty one, without findings; texts and values are read whole;
repeated rows are judged row by row; an empty table gives an empty result and an empty dictionary;
only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import per_text, utf8
from emberline.llm.spans import Span, digest, ordered, overlaps, written
from emberline.operators.dashboard import numbered

KINDS = ["assign", "access", "hex", "guess"]
MIN_GUESSES = 10.0
DICTIONARY_WORDS = 20_000

# The plain forms.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
MIN_ASSIGNED = 12

# What announces a credential.
CONTEXT_WORDS = [*ASSIGN_WORDS, "pwd", "passphrase", "passcode", "api-key", "access_key", "access-key", "private_key", "private-key", "credential", "bearer", "kennwort", "passwort", "contraseña", "mot de passe"]
CONTEXT = re.compile("|".join(sorted(map(re.escape, CONTEXT_WORDS), key=len, reverse=True)), re.I)
GAP = re.compile(
    r"""s?["'`]?(?:[ \t]*(?:(?:is|ist|est|es)(?=[ \t:="'`])[ \t]*[:=]*>?|[:=]+>?)[ \t]*|[ \t]+)""", re.I
)
# in quotes to the matching one, else to white space or to the next name of a list of assignments
QUOTED = re.compile(r""""((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`((?:[^`\\\n]|\\.)+)`""")
BARE = re.compile(r"""["'`]?((?:(?![,;](?:[A-Z]?[a-z_]{2,}|[A-Z_]{2,})=)\S)+)""")
CLOSING_TAG = re.compile(r"</\w+>")
MARKS = re.compile(r"""[-/.:_|\s,;<>()"'`]+""")
CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}

# Keyboard rows, words every guesser tries first, and signs that stand for letters.
KEY_ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
FIRST_WORDS = ["password", "123456", "qwerty", "admin", "letmein", "welcome", "secret", "changeme", "login", "test", "example", "user", "default", "root", "master", "dragon", "monkey", "none", "null", "your", "here", "key", "token", "xxx"]
LEET = str.maketrans("@4310$57!|", "aaeiosstil")
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d"
)
LONGEST_WORD = 24
PER_SEGMENT = math.log10(2)

KEYS = {key: (row, place) for row, keys in enumerate(KEY_ROWS) for place, key in enumerate(keys)}


def _near(a: str, b: str) -> bool:
    (r1, p1), (r2, p2) = KEYS.get(a, (9, 99)), KEYS.get(b, (-9, -99))
    return abs(r1 - r2) <= 1 and abs(p1 - p2) <= 1 and a != b


def brute_force(sign: str) -> float:
    """Powers of ten per character of unknown order."""
    if sign.isdigit():
        return 1.0
    return math.log10(26) if sign.isalpha() else math.log10(33)


def _runs(low: str, follows) -> list[int]:
    """For each place, the end of the longest run from there in which each character follows the last."""
    ends = list(range(1, len(low) + 1))
    for i in range(len(low) - 2, -1, -1):
        if follows(low[i], low[i + 1]):
            ends[i] = ends[i + 1]
    return ends


def _stepping(low: str, step: int) -> list[int]:
    return _runs(low, lambda a, b: a.isalnum() and b.isalnum() and ord(b) - ord(a) == step)


def _depths(ends: list[int]) -> list[int]:
    """For each place, how far it lies inside its run."""
    depths = [0] * len(ends)
    for i in range(1, len(ends)):
        if ends[i] == ends[i - 1]:
            depths[i] = depths[i - 1] + 1
    return depths


def guess_cost(value: str, ranks: dict[str, int], limit: float = math.inf) -> float:
    """Power of ten of the guesses for the cheapest segmentation of a value; infinite if it reaches ``limit``.

    No price is negative, so whatever starts where the limit is reached can be left out. Deep inside a
    run of one sign or of the alphabet no new run is begun, as the one begun before is cheaper.
    """
    low = value.lower()
    plain = low.translate(LEET)
    size = len(low)
    repeats = _runs(low, str.__eq__)
    walks = _runs(low, _near)
    steps = [_stepping(low, 1), _stepping(low, -1)]
    depths = [_depths(ends) for ends in (repeats, *steps)]
    cost = [0.0] + [math.inf] * size

    def offer(end: int, price: float) -> None:
        if price < cost[end] and price < limit:
            cost[end] = price

    for i in range(size):
        if cost[i] == math.inf:
            continue
        here = cost[i] + (PER_SEGMENT if i else 0.0)
        # brute force grows one character at a time, as one segment
        offer(i + 1, cost[i] + brute_force(value[i]) + (0.0 if i else PER_SEGMENT))
        for j in range(i + 3, min(size, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            if rank is None and plain[i:j] != low[i:j]:
                rank = ranks.get(plain[i:j])
                rank = rank and rank * 4
            if rank is not None:
                cased = value[i:j] != low[i:j]
                offer(j, here + math.log10(rank + 1) + (math.log10(4) if cased else 0.0))
        for j in range(i + 3, repeats[i] + 1 if depths[0][i] < 2 * LONGEST_WORD else 0):
            offer(j, here + math.log10(36 * (j - i)))
        for j in range(i + 3, walks[i] + 1):
            price = here + math.log10(48 * 4) + 0.5 * (j - i)
            if price >= limit:
                break
            offer(j, price)
        for ends, depth in zip(steps, depths[1:]):
            for j in range(i + 3, ends[i] + 1 if depth[i] < 2 * LONGEST_WORD else 0):
                offer(j, here + math.log10(72 * (j - i)))
        if low[i].isdigit():
            date = DATE.match(low, i)
            if date:
                offer(date.end(), here + math.log10(365 * 120))
                if date.end() >= i + 4 and low[i : i + 2] in ("19", "20"):
                    offer(i + 4, here + math.log10(120))
    return cost[size]


def base_spans(text: str, low: str | None = None) -> list[Span]:
    low = text.lower() if low is None else low
    spans = []
    if any(word in low for word in ASSIGN_WORDS):
        spans += [Span(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    spans += [Span(m.start(), "access", m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [Span(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return ordered(spans, KINDS)


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    """Without closing marks, tags and brackets that were not opened inside, nor brackets around it all."""
    number = {sign: text.count(sign, start, end) for pair in CLOSERS.items() for sign in pair}
    while end > start:
        last = text[end - 1]
        tag = CLOSING_TAG.fullmatch(text, max(start, text.rfind("<", start, end)), end) if last == ">" else None
        if tag or last in CLOSERS and text[start] == CLOSERS[last]:
            number[last] -= 1
            number[CLOSERS[last]] -= 1
            start, end = (start, tag.start()) if tag else (start + 1, end - 1)
        elif last in CLOSERS and number[last] > number[CLOSERS[last]]:
            number[last] -= 1
            end -= 1
        elif last in ".,:;!?\"'`":
            end -= 1
        else:
            break
    return start, max(start, end)


def value_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """The whole value that begins at a place, with its quotes left out, and if it had some."""
    quoted = QUOTED.match(text, at)
    if quoted:
        return (*quoted.span(quoted.lastindex), True)
    bare = BARE.match(text, at)
    return (*_stripped(text, *bare.span(1)), False) if bare else None


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """What stands after a context word and a gap, and if "bearer", "is" or a sign of assignment announces it.

    A value that is itself a context is left to that context.
    """
    for word in CONTEXT.finditer(text):
        gap = GAP.match(text, word.end())
        value = value_at(text, gap.end()) if gap else None
        if value is None:
            continue
        start, end, quoted = value
        inner = CONTEXT.match(text, start)
        if inner and (inner.end() >= end or text[inner.end() : end] in ("s", "S") or not quoted and GAP.match(text, inner.end())):
            continue
        yield start, end, word.group().lower() == "bearer" or bool(gap.group().strip("sS \t\"'`"))


def without_values(text: str) -> str:
    """The text without values that are announced as credentials."""
    low = text.lower()
    if not any(word in low for word in CONTEXT_WORDS):
        return text
    kept, at = [], 0
    for start, end, announced in candidates(text):
        if announced and end > at:
            kept.append(text[at : max(at, start)])
            at = end
    return "".join([*kept, text[at:]])


def guessed_spans(text: str, ranks: dict[str, int], base: list[Span], low: str) -> list[Span]:
    """Values in credential contexts that are expensive to guess."""
    if not any(word in low for word in CONTEXT_WORDS):
        return []
    found: list[Span] = []
    for start, end, announced in candidates(text):
        value = text[start:end]
        if len(value) < 6 or not any(map(str.isalnum, value)):
            continue
        span = Span(start, "guess", end)
        # a plain finding may hold only the head of a value; a later context may stand inside an earlier value
        if any(other.start <= start and end <= other.end for other in base) or overlaps(span, found[-1:]):
            continue
        # a quotation that merely follows is judged word by word
        if any(is_secret(part, ranks) for part in ([value] if announced else value.split())):
            found.append(span)
    return found


def is_secret(value: str, ranks: dict[str, int]) -> bool:
    """Prose that is merely hyphenated or cut by marks is priced by its dearest part."""
    parts = [part for part in MARKS.split(value) if part]
    priced = parts if parts and all(map(str.isalpha, parts)) else [value]
    return any(guess_cost(part, ranks, MIN_GUESSES) >= MIN_GUESSES for part in priced)


def find(text: str, ranks: dict[str, int]) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans."""
    low = text.lower()
    base = base_spans(text, low)
    if len(low) != len(text):  # lower-casing a few letters lengthens them; contexts are matched on the text
        low = text.casefold()
    return base, ordered([*base, *guessed_spans(text, ranks, base, low)], KINDS)


def learn_dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> dict[str, int]:
    """Rank by frequency of the most frequent words of three letters or more; ties go by the word.

    Words are counted over all documents, first per batch and then by a shuffle, and ranked by a sort
    over ranges; only the ``words`` top ones, of at most LONGEST_WORD letters, reach the driver. Announced
    values are left out (``without_values``); a word that also stands elsewhere keeps its rank from there.
    """

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter[bytes] = Counter()
            for text in frame["text"]:
                counts.update(utf8(without_values(text or "")).lower().split())
            kept = []
            for word, count in counts.items():
                shown = word.decode("utf-8", "replace").strip(".,;:!?\"'()")
                if 3 <= len(shown) <= LONGEST_WORD and shown.isalpha():
                    kept.append((shown, count))
            yield pd.DataFrame(kept, columns=["word", "n"])

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(counted, "word string, n bigint")
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"))
    top = numbered(totals, [F.col("n").desc(), F.col("word")], "rank").where(F.col("rank") <= words)
    ranks = {row["word"]: row["rank"] + len(FIRST_WORDS) for row in top.select("word", "rank").collect()}
    return ranks | {word: rank for rank, word in enumerate(FIRST_WORDS, 1)}


REPORT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guessed bigint"


def report(
    docs: DataFrame, ranks: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id, plain findings per kind, their digest, all spans, and how many were priced."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks if ranks is not None else learn_dictionary(docs, text_col))

    def one():
        known = shared.value

        def judge(text: str) -> tuple:
            base, spans = find(text, known)
            counts = [sum(span.kind == kind for span in base) for kind in KINDS[:3]]
            return (*counts, digest(base), written(spans), len(spans) - len(base))

        return judge

    return per_text(docs, id_col, text_col, REPORT, one)
