"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are compared as their words, lower-cased and joined
by single spaces.  An item of m characters has an error budget k of ``rate`` m
edits.  It is cut into k + 1 pieces: a passage within k edits of the item
holds at least one piece untouched.  All pieces of all items are found in one
run over a text (an Aho-Corasick automaton), and each hit is verified upwards:

* pieces are paired into a tree, and a node over p pieces has budget p - 1.
  If both children of a node missed their budgets, the node misses its own;
  so from the piece that was hit, every node up to the root must match;
* the first pair is checked by plain comparison (one error leaves a half of
  the sibling untouched), the nodes above by Myers' bit-parallel distance, the
  item as a bit vector against the window that the hit leaves open.

A match is reported once for each (document, item): the least distance and the
first span that has it, in code points of the original text.  A hit whose
diagonal was verified already is not verified again; any other one is, until
an exact copy is found.

Items under ``short`` characters have a budget of 0 to 2 and match whole words
only: the span must start where a word starts and end where one ends, as
chance would find parts of words.

The benchmark is a stated query set.  It goes to the tasks in blocks of about
``block_chars`` characters, one block at a time: the driver holds one block,
and with more than one, each block's run over the documents is a written stage
of its own.  So nothing grows with the documents or without bound with the
benchmark.

Defined results: a null or empty text has no match; items without a letter or
digit (so null and empty ones) have nothing to search; items equal in id and
text are one, items equal in text only match each for itself, and repeated
rows too; an empty benchmark gives no match and drops nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, record_batch, table, texts_of

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class EditSpec:
    rate: float = 0.1
    short: int = 25
    block_chars: int = 4_000_000


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def original_offsets(text: str) -> tuple[list[int], list[int]]:
    """For each character of ``normal(text)``, where its place in ``text``
    starts and ends."""
    # A character may have a longer lower case; it counts for each part.
    source = [i for i, c in enumerate(text) for _ in c.lower()]
    lower = "".join(c.lower() for c in text)
    at: list[int] = []
    for m in _WORD.finditer(lower):
        if at:
            at.append(source[m.start()] - 1 if m.start() else 0)
        at.extend(source[m.start():m.end()])
    return at, [i + 1 for i in at]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance, end of the first such match) of a pattern of length
    ``m``, anywhere in ``text``, bit-parallel."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


class Item:
    """An item's pieces and the tree over them."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.id, self.text = item_id, text
        n = int(len(text) * rate) + 1
        cuts = [len(text) * i // n for i in range(n + 1)]
        self.pieces = list(zip(cuts, cuts[1:]))
        #: For each piece its ancestors (start, end, budget), the root last.
        self.above: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        level = [(i, i + 1) for i in range(n)]
        while len(level) > 1:
            level = [(level[i][0], level[min(i + 1, len(level) - 1)][1]) for i in range(0, len(level), 2)]
            for a, b in level:
                for i in range(a, b):
                    if b - a > 1 and (not self.above[i] or self.above[i][-1] != (cuts[a], cuts[b], b - a - 1)):
                        self.above[i].append((cuts[a], cuts[b], b - a - 1))
        self.masks: dict[tuple[int, int], dict[str, int]] = {}
        self.budget = n - 1

    def mask(self, a: int, b: int) -> dict[str, int]:
        if (a, b) not in self.masks:
            self.masks[a, b] = masks(self.text[a:b])
        return self.masks[a, b]

    def beside(self, piece: int, text: str, diagonal: int) -> bool:
        """Whether the piece's first pair can match with one error: a half of
        its sibling stands at its place or one beside."""
        a, b = self.pieces[piece ^ 1]
        middle = (a + b) // 2
        for x, y in ((a, middle), (middle, b)):
            part = self.text[x:y]
            at = diagonal + x
            if text.startswith(part, at) or text.startswith(part, at + 1) or at and text.startswith(part, at - 1):
                return True
        return False


def edit_distance(p: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            before, row[j] = row[j], min(before + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, short: int = 25):
        import ahocorasick
        self.items, self.short = [Item(i, t, rate) for i, t in items], short
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for j, (a, b) in enumerate(item.pieces):
                where.setdefault(item.text[a:b], []).append((k, j))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def matches(self, text: str, first_only: bool = False) -> dict[int, tuple[int, int, int]]:
        """Item number to (distance, start, end) in the normal ``text``."""
        found: dict[int, tuple[int, int, int]] = {}
        if self.empty or not text:
            return found
        # A window is known by its node and diagonal: nothing is checked twice.
        missed, seen = set(), set()
        for last, (n, at) in self.automaton.iter(text):
            start = last + 1 - n
            for k, j in at:
                item = self.items[k]
                diagonal = start - item.pieces[j][0]
                if k in found and found[k][0] == 0 or (k, diagonal) in seen:
                    continue
                hit = (self._short if len(item.text) < self.short else self._long)(item, k, j, text, diagonal, missed)
                if hit is None:
                    continue
                seen.add((k, diagonal))
                if k not in found or hit < found[k]:
                    found[k] = hit
                if first_only:
                    return found
        return found

    def _short(self, item: Item, k: int, j: int, text: str, diagonal: int, missed: set) -> tuple[int, int, int] | None:
        """The least distance over the spans of whole words near ``diagonal``."""
        budget, end = item.budget, diagonal + len(item.text)
        starts = [s for s in range(max(0, diagonal - budget), diagonal + budget + 1) if s == 0 or text[s - 1:s] == " "]
        ends = [e for e in range(end - budget, end + budget + 1) if e == len(text) or text[e:e + 1] == " "]
        spans = [(edit_distance(item.text, text[s:e]) if budget else int(text[s:e] != item.text), s, e)
                 for s in starts for e in ends if s < e]
        best = min(spans, default=None)
        return best if best and best[0] <= budget else None

    def _long(self, item: Item, k: int, j: int, text: str, diagonal: int, missed: set) -> tuple[int, int, int] | None:
        above = item.above[j]
        if above and above[0][2] == 1 and not item.beside(j, text, diagonal):
            return None
        if not above:
            return 0, diagonal, diagonal + len(item.text)
        for a, b, budget in above:
            key = (k, a, b, diagonal)
            if key in missed:
                return None
            low = max(0, diagonal + a - budget)
            distance, end = myers(item.mask(a, b), b - a, text[low:max(0, diagonal + b + budget)])
            if distance > budget:
                missed.add(key)
                return None
        end += low
        # Backwards from the end, for the start.
        back = text[max(0, end - len(item.text) - distance):end][::-1]
        return distance, end - myers(masks(item.text[::-1]), len(item.text), back)[1], end


def item_blocks(benchmark: DataFrame, spec: EditSpec) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks, and the normal items of one after the other."""
    items = (benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
             .where("text is not null").distinct())
    items = materialise(items, "benchmark-items")
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // spec.block_chars)

    def block(i: int) -> list[tuple[int, str]]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        return sorted(((r.item_id, t) for r in rows if (t := normal(r.text))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return n, map(block, range(n))


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()),
                    ("start", pa.int32()), ("end", pa.int32())])
_FOUND_DDL = "doc_id long, item_id long, distance int, budget int, start int, end int"


def _finder(items: list[tuple[int, str]], spec: EditSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, spec.rate, spec.short)
        for batch in batches:
            rows = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch)):
                found = matcher.matches(normal(text))
                if found:
                    starts, ends = original_offsets(text)
                    for k, (distance, a, b) in sorted(found.items()):
                        item = matcher.items[k]
                        rows.append((doc_id, item.id, distance, item.budget, starts[a], ends[b - 1]))
            if rows:
                yield record_batch(_FOUND, list(map(list, zip(*rows))))
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, spec: EditSpec = EditSpec()) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end) of every document that
    holds an item within its budget."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], _FOUND_DDL)
    n, blocks = item_blocks(benchmark, spec)
    for items in blocks:
        part = map_arrow(slim, _finder(items, spec), _FOUND_DDL)
        found = found.unionByName(part if n == 1 else materialise(part, "benchmark-matches"))
    return found


def _cleaner(items: list[tuple[int, str]], spec: EditSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, spec.rate, spec.short)
        for batch in batches:
            texts = texts_of(batch)
            yield batch.filter(pa.array([not matcher.matches(normal(t), first_only=True) for t in texts], pa.bool_()))
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, spec: EditSpec = EditSpec()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    n, blocks = item_blocks(benchmark, spec)
    for items in blocks:
        docs = map_arrow(docs, _cleaner(items, spec), docs.schema)
        docs = docs if n == 1 else materialise(docs, "decontaminated")
    return docs


def op2_benchmark_edits(spark, sf_dir):
    """Every (document, item) pair with a passage within 10 % edits of the item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
