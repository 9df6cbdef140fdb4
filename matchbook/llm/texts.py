"""Cuts of very long texts, so that the lists made from one text stay short."""

from __future__ import annotations

from collections.abc import Iterator

import regex

#: Characters after which a text is cut at the next safe place.
CUT_CHARS = 1 << 18
#: One space between two characters that are no white space.
SAFE = regex.compile(r"(?<=\S)(?= \S)")


def cuts(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Pieces of at least ``size`` characters, cut before a single space between two words.

    A text without such a place is one piece.
    """
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text
