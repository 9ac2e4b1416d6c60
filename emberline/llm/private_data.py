"""Personal data, also where it is disguised, with offsets into the original text.

Plain findings (``base_spans``) come from the text as it is. For disguised ones the text goes through
a chain of small transducers: look-alike characters become ASCII, spelled digits become digits, and
"at" and "dot" in words or brackets become signs. Every transducer keeps, for each character it
writes, the start and end of what it read, and the chain composes these maps; so a finding in the
normalised text is a span of the original one. A finding counts only if it holds a rewritten
character and doesn't overlap a plain one of its kind.

Defined cases: a null text is an empty one, without findings; texts are scanned whole, in time
proportional to their length; repeated rows are judged row by row; an empty table gives an empty
result; other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import per_text
from emberline.llm.spans import Span, digest, masked, ordered, overlaps, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The definitions of the plain findings.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)

# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "А": "A", "В": "B", "в": "b", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H",
    "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "к": "k", "М": "M", "м": "m", "о": "o", "О": "O", "р": "p",
    "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "Т": "T", "т": "t", "у": "y", "У": "Y", "ѵ": "v", "ԝ": "w", "х": "x",
    "Х": "X", "α": "a", "Α": "A", "Β": "B", "ϲ": "c", "Ε": "E", "Η": "H", "ι": "i", "Ι": "I", "ϳ": "j", "Κ": "K",
    "κ": "k", "Μ": "M", "Ν": "N", "ν": "v", "ο": "o", "Ο": "O", "ρ": "p", "Ρ": "P", "Τ": "T", "τ": "t", "υ": "u",
    "Υ": "Y", "Χ": "X", "χ": "x", "Ζ": "Z", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ӏ": "l", "Ӏ": "l", "ո": "n",
    "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", " ": " ", " ": " ",
    "。": ".", "․": ".", "٫": ".", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}

# Digits, signs and multiples in words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "oh": "0",
}
MULTIPLES = {"double": 2, "triple": 3}
AT_WORDS = ["at", "arroba", "arobase"]
DOT_WORDS = ["dot", "punkt", "punto", "point"]


def _readings() -> dict[str, str]:
    """Look-alikes, and by rule all full-width, mathematical and other forms of ASCII characters."""
    table = dict(LOOK_ALIKES)
    for code in [*range(0x80, 0x3100), *range(0xA600, 0xAC00), *range(0xFB00, 0x12000), *range(0x1D400, 0x1FC00)]:
        sign = chr(code)
        kind = unicodedata.category(sign)
        if sign in table or kind in ("Cn", "Cs", "Co", "No", "Sk", "Zs") or sign in "ªº":
            continue
        value = unicodedata.decimal(sign, None)
        plain = str(value) if value is not None else unicodedata.normalize("NFKC", sign)
        if len(plain) == 1 and plain.isascii():
            table[sign] = plain
    return table


READINGS = _readings()


def _class(signs) -> str:
    """A character class; neighbouring code points are written as ranges."""
    out, codes = [], sorted(map(ord, signs))
    start = 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(f"{re.escape(chr(codes[start]))}-{re.escape(chr(codes[i - 1]))}")
            start = i
    return f"[{''.join(out)}]"


DISGUISED_SIGN = re.compile(_class(READINGS))
_words = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_digit = rf"(?:(?:{'|'.join(MULTIPLES)})\s+)?(?:{_words})"
DIGIT_WORD = re.compile(rf"(?<!\w)(?:(double|triple)\s+)?({_words}|plus)(?!\w)", re.I)
DIGIT_MARKS = {word.encode() for word in [*DIGIT_WORDS, "plus"]}
BETWEEN = re.compile(r"[\s,-]+")
_open, _close = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_at = rf"(?:{_open}(?:{'|'.join(AT_WORDS)}|@){_close}|\s+(?:{'|'.join(AT_WORDS)})\s+)"
_dot = rf"(?:{_open}(?:{'|'.join(DOT_WORDS)}|\.){_close}|\s+(?:{'|'.join(DOT_WORDS)})\s+)"
AT, DOT = re.compile(_at, re.I), re.compile(_dot, re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_dot})(?=[0-9])", re.I)
SAID_DOMAIN = re.compile(rf"(?:{_at}|@)[A-Za-z0-9-]+(?:(?:{_dot}|\.)[A-Za-z0-9-]+)+", re.I)
SAID_LOCAL_DOT = re.compile(rf"(?:{_dot})\Z", re.I)
# what each rewriting by spoken_signs needs somewhere: a sign in brackets, or a dot in words
BRACKETED_SIGN = re.compile(rf"[\[({{<]\s*(?:{'|'.join([*AT_WORDS, *DOT_WORDS])}|[@.])\s*[\])}}>]", re.I)
WORDED_DOT = re.compile(rf"\s(?:{'|'.join(DOT_WORDS)})\s", re.I)
_to_space = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


@dataclass
class Reading:
    """A text as read, and for each of its characters where it began and ended in the original."""

    text: str
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    changed: list[bool] = field(default_factory=list)

    @staticmethod
    def of(text: str) -> Reading:
        size = len(text)
        return Reading(text, list(range(size)), list(range(1, size + 1)), [False] * size)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Reading:
        """Replace (start, end, by) stretches, given in order and apart from each other."""
        if not edits:
            return self
        text, starts, ends, changed, at = [], [], [], [], 0
        for start, end, by in edits:
            text += [self.text[at:start], by]
            starts += self.starts[at:start] + [self.starts[start]] * len(by)
            ends += self.ends[at:start] + [self.ends[end - 1]] * len(by)
            changed += self.changed[at:start] + [True] * len(by)
            at = end
        text.append(self.text[at:])
        return Reading(
            "".join(text), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]
        )

    def span(self, kind: str, start: int, end: int) -> Span | None:
        """The original span, if anything in it was rewritten."""
        if not any(self.changed[start:end]):
            return None
        return Span(self.starts[start], kind, self.ends[end - 1])


def plain_signs(reading: Reading) -> Reading:
    return reading.rewritten(
        [(m.start(), m.end(), READINGS[m.group()]) for m in DISGUISED_SIGN.finditer(reading.text)]
    )


def spoken_digits(reading: Reading) -> Reading:
    """Digit words to digits, ``plus`` to its sign, and no gaps between digits of which one was a word."""
    text, edits = reading.text, []
    for m in DIGIT_WORD.finditer(text):
        # a capital i with a dot matches i, and lower-casing leaves its dot as a sign of its own
        multiple, word = (m.group(1) or "").lower(), m.group(2).lower().replace("\u0307", "")
        sign = "+" if word == "plus" else DIGIT_WORDS[word] * MULTIPLES.get(multiple, 1)
        edits.append([m.start(), m.end(), sign])
    out: list[tuple[int, int, str]] = []
    for i, (start, end, sign) in enumerate(edits):
        gap = BETWEEN.match(text, end)
        if gap:
            following = edits[i + 1][0] if i + 1 < len(edits) else -1
            if gap.end() == following and edits[i + 1][2] != "+" or text[gap.end() : gap.end() + 1].isdecimal():
                end = gap.end()
        if not out or out[-1][1] != start:
            back = start
            while back and text[back - 1] in " \t\n\r,-":
                back -= 1
            if sign != "+" and 0 < back < start and text[back - 1] in "0123456789" and (not out or out[-1][1] <= back):
                start = back
        out.append((start, end, sign))
    return reading.rewritten(out)


def spoken_signs(reading: Reading) -> Reading:
    """Dots between numbers, then the signs of addresses: with a bare "at" a dot must be disguised too."""
    reading = reading.rewritten([(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(reading.text)])
    text, edits, last = reading.text, [], 0
    for m in SAID_DOMAIN.finditer(text):
        at = AT.match(text, m.start())
        here = [(at.start(), at.end(), "@")] if at else []
        if at is None and text[m.start()] != "@":
            continue
        after = at.end() if at else m.start() + 1
        dots = [(d.start(), d.end(), ".") for d in DOT.finditer(text, after, m.end())]
        if at and at.group().strip().isalpha() and not dots:
            continue
        before, back = [], m.start()
        while True:
            while back > last and text[back - 1] in LOCAL:
                back -= 1
            said = SAID_LOCAL_DOT.search(text[max(last, back - 12) : back])
            if said is None or max(last, back - 12) + said.start() <= last:
                break
            begin = max(last, back - 12) + said.start()
            if text[begin - 1] not in LOCAL:
                break
            before.insert(0, (begin, back, "."))
            back = begin
        if back == m.start():
            continue
        edits += before + here + dots
        last = m.end()
    return reading.rewritten(edits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: the whole run of local characters before a sign that a domain follows."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(sign for sign in found if sign in "0123456789")


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all findings in a text as it stands."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m.group().split(".")]
        if all(len(part) < 4 and int(part) < 256 for part in parts):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = _digits(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1]:
                yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    return ordered((Span(start, kind, end) for kind, start, end in matches(text)), KINDS)


def has_digit_words(text: str) -> bool:
    if text.isascii():
        return not DIGIT_MARKS.isdisjoint(text.lower().encode().translate(_to_space).split())
    return DIGIT_WORD.search(text) is not None


def has_said_signs(text: str) -> bool:
    return BRACKETED_SIGN.search(text) is not None or WORDED_DOT.search(text) is not None


def readings(text: str) -> list[Reading]:
    """The normalised readings of a text, none if nothing in it is disguised.

    Each transducer is left out only where it has nothing to rewrite. As a digit word that merely
    follows a number is drawn to it, the text is also read with digit words as they stand.
    """
    plain = Reading.of(text) if text.isascii() else plain_signs(Reading.of(text))
    first = [plain]
    if has_digit_words(plain.text):
        first.insert(0, spoken_digits(plain))
    made = [spoken_signs(reading) if has_said_signs(reading.text) else reading for reading in first]
    return [reading for reading in made if any(reading.changed)]


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Findings that only a normalised reading shows; of overlapping ones of a kind the first reading's."""
    found: list[Span] = []
    for reading in readings(text):
        taken = [*base, *found]
        for kind, start, end in matches(reading.text):
            span = reading.span(kind, start, end)
            if span and not overlaps(span, (other for other in taken if other.kind == kind)):
                found.append(span)
    return found


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans."""
    base = base_spans(text)
    return base, ordered([*base, *disguised_spans(text, base)], KINDS)


def _report(text: str) -> tuple:
    base, spans = find(text)
    counts = [sum(span.kind == kind for span in base) for kind in KINDS]
    return (*counts, digest(base), written(spans), len(spans) - len(base))


REPORT = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_disguised bigint"
)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, plain findings per kind, their digest, all spans, and how many are disguised."""
    return per_text(docs, id_col, text_col, REPORT, lambda: _report)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in the text replaced by its kind in angle brackets; nulls stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else masked(text, find(text)[1]))

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
