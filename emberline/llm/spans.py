"""Spans of findings in a text, and how they are written down."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple


class Span(NamedTuple):
    """A finding in code points, end exclusive."""

    start: int
    kind: str
    end: int


def ordered(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    """By start, then in the order in which the kinds are listed, then by end."""
    place = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda span: (span.start, place[span.kind], span.end))


def written(spans: list[Span]) -> str:
    return ",".join(f"{span.kind}:{span.start}:{span.end}" for span in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def overlaps(span: Span, others: Iterable[Span]) -> bool:
    return any(span.start < other.end and other.start < span.end for other in others)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    out, at = [], 0
    for span in sorted(spans):
        if span.start >= at:
            out += [text[at : span.start], f"<{span.kind.upper()}>"]
            at = span.end
        elif span.end > at:
            at = span.end
    out.append(text[at:])
    return "".join(out)
