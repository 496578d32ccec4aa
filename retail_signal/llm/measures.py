"""Counts over one whole text, for the quality rules and the quality classifier.

Words are runs of anything but space and TAB..CR; ``bytes.split()`` cuts UTF-8
at exactly those bytes.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACES)


def symbols(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)


def share_of(raw: bytes, kind: bytes) -> int:
    """How many bytes of ``raw`` are in ``kind``."""
    return len(raw) - len(raw.translate(None, kind))


def lines_and_repeats(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by ``width``-word windows that occur twice or more."""
    if len(words) <= width:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    windows = [joined[a:b] for a, b in zip([0, *ends], ends[width - 1:])]
    windows[-1] += b" "
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    first = np.flatnonzero([seen[w] > 1 for w in windows])
    np.add.at(marks, first, 1)
    np.add.at(marks, first + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())
