"""Cutting long texts where a byte-level tokenizer cannot notice.

The split pattern of the rank files reads from left to right, never looks behind and looks ahead only within white
space. No match runs from a letter, digit or mark into a white-space character, so a cut between an ASCII letter or
digit and a following blank or line feed leaves every match as it is. Where a text has no blanks, other sure cuts are
used: between a letter and a digit, or behind a CJK mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Characters of a piece, at least, where the text has a safe place to cut.
PIECE = 1 << 16

_SAFE = re.compile(
    r"(?<=[A-Za-z0-9.,])(?=[ \n])"
    r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[一-龥ぁ-ゖァ-ヺ])(?=[、。，！？0-9])"
)

#: White space as the library's expressions have it; Python's own class has four characters more.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=4)
def _long_run(size: int) -> re.Pattern[str]:
    return re.compile(rf"(?<![{_WHITE}])[{_WHITE}]{{{max(size, 2)},}}")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive parts of `text`; tokens of the parts are the tokens of the whole. A text without any safe place
    stays one piece, however long."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def long_blanks(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of `text`, and whether a part is one match of the split pattern: the head of a run of `size`
    white-space characters or more. The pattern takes such a run in one match, all but its last character if another
    character follows; the library's own search for that match overflows its stack at about a million characters."""
    start = 0
    for run in (_long_run(size).finditer(text) if len(text) >= size else ()):
        end = run.end() - (run.end() < len(text))
        if start < run.start():
            yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    if start < len(text) or not text:
        yield text[start:] if start else text, False
