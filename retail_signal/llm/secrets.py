"""Secret scan: known forms, and sliding-window entropy of candidate strings.

Known forms (``assign``, ``access``, ``hex``) are found by their patterns.
Further candidates are runs of key characters at least ``WINDOW`` long.  A
window of ``WINDOW`` characters slides over a candidate; the counts of its
characters, and the sum of c log2 c over them, are updated by the character
that enters and the one that leaves, so each step costs the same.  A window is
hot if its Shannon entropy reaches the limit of its character class (a class
is decided by counts too, kept in the same way).  Hot windows that touch form
one ``entropy`` span.

Suppressed: known forms (reported already) and what matches the allow-list
(UUIDs, the plain word 'example', counting sequences, the alphabet, a published
example key) are cut out of a candidate, and windows slide over what stands
between, so a key beside them is found.  A span is dropped if all pieces it
touches between the joints of a path or name read like words.

Positions are code points, ends exclusive.  Defined results: a null or empty
text has no findings; repeated rows are scanned each for itself; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, record_batch, table, texts_of

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)

#: Least entropy in bits of a hot window of 20 characters, by the class of its
#: characters; letters of one case alone must differ more than those of words
#: do, digits are taken for numbers.
LIMITS = {"one case": 4.1, "hex": 3.0, "one case and digits": 3.5, "both cases": 4.1, "both cases and digits": 3.8}

#: Strings that look random but are no secrets.  Each is cut out
#: of a run where it stands, and what is left beside it is scanned.
ALLOW = (
    r"(?<![0-9A-Za-z])(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?![0-9A-Za-z])",
    r"(?<![A-Za-z0-9])(?:[a-z]*example[a-z]*|[A-Z]*EXAMPLE[A-Z]*)(?![A-Za-z0-9])",
    r"(?:0123456789)+(?:abcdef|ABCDEF)*",
    r"(?i:abcdefghijklmnopqrstuvwxyz)",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
)
#: A piece of a path or of a name: a word of one case, or with capitals where
#: words begin, and short enough to be read.
_WORDS = re.compile(r"(?:[a-z]{1,16}|[A-Z]{1,16}|(?:[A-Z]?[a-z]{2,15}){1,4})\Z")
#: Vowels of words; a piece of five letters and more has one among any five.
_JOINTS = "/_=+-"
_NO_VOWEL = re.compile(r"(?i)[^aeiouy]{6}")


@dataclass(frozen=True)
class SecretSpec:
    window: int = WINDOW
    allow: Sequence[str] = ALLOW


def _class_of(digits: int, lower: int, upper: int, beyond_f: int, other: int) -> str | None:
    """Class of a window from its counts of digits, lower and upper case
    letters, letters beyond F, and other signs."""
    if digits and lower + upper and not (lower and upper) and not beyond_f + other:
        return "hex"
    if lower and upper:
        return "both cases and digits" if digits else "both cases"
    if not lower + upper:
        return None
    return "one case and digits" if digits else "one case"


def hot_spans(text: str, window: int = WINDOW) -> list[tuple[int, int, float]]:
    """(start, end, most bits) of the touching hot windows of ``text``."""
    counts: dict[str, int] = {}
    weight, digits, lower, upper, beyond = 0.0, 0, 0, 0, 0
    clog = [0.0] + [c * log2(c) for c in range(1, window + 2)]
    spans: list[list] = []
    for i, c in enumerate(text):
        for ch, step in ((c, 1), (text[i - window] if i >= window else "", -1)):
            if not ch:
                continue
            had = counts.get(ch, 0)
            counts[ch] = had + step
            weight += clog[had + step] - clog[had]
            if "0" <= ch <= "9":
                digits += step
            elif "a" <= ch <= "z":
                lower += step
                beyond += step * (ch > "f")
            elif "A" <= ch <= "Z":
                upper += step
                beyond += step * (ch > "F")
        if i + 1 < window:
            continue
        bits = log2(window) - weight / window
        kind = _class_of(digits, lower, upper, beyond, window - digits - lower - upper)
        if kind and bits >= LIMITS[kind]:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1][1:] = [i + 1, max(bits, spans[-1][2])]
            else:
                spans.append([start, i + 1, bits])
    return [tuple(s) for s in spans]


def in_words(text: str, start: int, end: int, first: int, last: int) -> bool:
    """Whether the span stands in names only: all pieces it touches, between
    the joints of paths and names in start to end, read like words."""
    while first > start and text[first - 1] not in _JOINTS:
        first -= 1
    while last < end and text[last] not in _JOINTS:
        last += 1
    pieces = re.split(f"[{_JOINTS}]", text[first:last])
    return all(not p or _WORDS.match(p) and not _NO_VOWEL.search(p) for p in pieces)


def findings(text: str, spec: SecretSpec, allow: re.Pattern) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) by start, then kind."""
    found = [("assign", m.start(), m.end(), None) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    known = [(0, 0)]  # disjoint, ascending
    for _, start, end, _ in sorted(found, key=lambda f: f[1]):
        if start < known[-1][1]:
            known[-1] = (known[-1][0], max(end, known[-1][1]))
        else:
            known.append((start, end))
    for m in _CANDIDATE.finditer(text):
        cuts = [c for part in _outside(known, m.start(), m.end()) for c in _outside(
            [(0, 0), *((w.start(), w.end()) for w in allow.finditer(text, *part))], *part)]
        for start, end in cuts:
            for first, last, bits in hot_spans(text[start:end], spec.window):
                if not in_words(text, start, end, start + first, start + last):
                    found.append(("entropy", start + first, start + last, bits))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _outside(known: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """What of start to end no span of ``known`` covers."""
    parts = []
    for a, b in known[max(bisect_left(known, (start,)) - 1, 0):bisect_left(known, (end,))]:
        if a > start:
            parts.append((start, a))
        start = max(start, b)
    return [*parts, (start, end)] if start < end else parts


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(_SPAN))])
_FOUND_DDL = "doc_id long, findings array<struct<kind:string,start:int,end:int,bits:double>>"


def _scanner(spec: SecretSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{_inline(a)})" for a in spec.allow) or r"(?!)")
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "bits"), f)) for f in findings(t, spec, allow)]
                     for t in texts_of(batch)]
            yield record_batch(_FOUND, [column(batch, "doc_id"), spans])
    return run


def _inline(pattern: str) -> str:
    """A leading flag group made local, so that patterns can be joined."""
    return f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else pattern


def scan(docs: DataFrame, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """(doc_id, findings) of every whole text."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, _scanner(spec), _FOUND_DDL)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_entropy(spark, sf_dir):
    """Secrets of every document, with a digest of those of known form."""
    found = scan(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))
