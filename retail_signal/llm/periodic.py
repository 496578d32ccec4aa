"""Runs: stretches of words that repeat with a period, found in scale-sized tiles.

A run is a maximal stretch of words with smallest period q (words q apart are
the same) of at least ``max(least, times * q)`` words.

Method.  Periods are dealt to octaves [P, 2P).  In an octave a document is a
row of blocks of P words.  Where words i and i + q agree all along a run, they
do so for ``length - q`` >= 2P positions, so at least one whole block agrees
with the P words that start q further on.  Such blocks are found by comparing
rolling hashes, and each is then solved exactly at its boundary b: the
Z-function of the words from b on says how far they agree with the words q
further on and whether the period is the smallest, the Z-function of the
reversed words before b how far back they agree.  Reach is limited to 2P words
on and P words back, so a block never looks further than its tile.

A document of up to ``core`` words is one tile for all octaves, solved where
the document is read.  A longer one is exploded into overlapping tiles: of
``core`` words for the small octaves, of 8P words for each larger one.  The
tiles are dealt over the cluster, so one giant document is many tasks' work.
What a tile finds are fragments: intervals of agreeing positions of a period.
A shuffle by (document row, period) stitches fragments that overlap or touch
into whole runs; nothing but fragments and the texts that have some moves.

Defined results: a null or empty text has no words, no run and an empty
collapsed text; repeated and null ids are rows of their own; an empty table
gives an empty result; other columns are ignored.  ``times`` is 3 or more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, record_batch, table
from .measures import words_of

LEAST = 24   # words of the shortest run
TIMES = 3    # periods in the shortest run
CORE = 4096  # words of a tile of the small octaves, without its context

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def base_block(least: int, times: int) -> int:
    """Words of the first octave's blocks: it serves all periods below twice
    that.  Every run of such a period agrees along a whole block of a grid."""
    width = 1
    while all(max(least - q, (times - 1) * q) >= 4 * width - 1 for q in range(1, 4 * width)):
        width *= 2
    return width


def z_function(s: list) -> list:
    """z[i]: how many elements of s[i:] agree with s from its start on."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice ``width`` from those of ``width``."""
    out = h[:-width] * _MULTIPLIER + h[width:]
    out ^= out >> np.uint64(29)
    return out


def _candidates(h: np.ndarray, start: int, blocks: int, width: int, periods: range) -> dict[int, list[int]]:
    """{offset of a block: periods for which its hash comes again}."""
    need = start + (blocks - 1) * width + periods.stop
    if need > len(h):
        h = np.concatenate([h, np.zeros(need - len(h), np.uint64)])
    later = np.lib.stride_tricks.as_strided(h[start + periods.start:], (blocks, len(periods)), (8 * width, 8))
    block, which = np.nonzero(later == h[start:start + blocks * width:width][:blocks, None])
    found: dict[int, list[int]] = {}
    for b, q in zip((start + block * width).tolist(), (which + periods.start).tolist()):
        found.setdefault(b, []).append(q)
    return found


def _solve_block(codes: np.ndarray, b: int, width: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """(q, s, e): words i and i + q agree for s <= i < e, as far as the block
    at ``b`` sees, for those of ``periods`` that are smallest periods."""
    z = z_function(codes[b:b + 4 * width].tolist())
    periods = [q for q in periods if q < len(z) and z[q] >= width]
    if not periods:
        return
    top = min(b + 2 * width, len(codes))
    back = codes[max(0, b - width):b][::-1].tolist()
    before = z_function([*back, -1, *codes[b - len(back):top][::-1].tolist()])[len(back) + 1:]
    shorter = [d for d in range(1, width) if z[d] >= d]
    for q in periods:
        if any(q % d == 0 and z[d] >= q - d for d in shorter if 2 * d <= q):
            continue
        yield q, b - (before[top - b - q] if back else 0), b + min(z[q], 2 * width)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def solve_tile(codes: np.ndarray, n: int, lo: int, first: int, last: int, small: int, large: int,
               least: int, times: int) -> list[tuple[int, int, int]]:
    """Fragments (period, s, e) of the blocks that start in [first, last) of a
    document of ``n`` words, for octaves ``small`` to ``large``; ``codes`` are
    its words from ``lo`` on.  A fragment inside the tile that is too short
    for a run is left out, one at an edge of the tile stays."""
    found: list[tuple[int, int, int]] = []
    base = base_block(least, times)
    h = codes.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    width = 1
    while width <= large and len(h):
        if width >= small:
            blocks = min(-(-(last - first) // width), -(-(len(codes) - (first - lo)) // width))
            periods = range(1 if width == base else width, 2 * width)
            spans: dict[int, list[tuple[int, int]]] = {}
            for b, some in _candidates(h, first - lo, blocks, width, periods).items():
                for q, s, e in _solve_block(codes, b, width, some):
                    spans.setdefault(q, []).append((lo + s, lo + e))
            for q, some in spans.items():
                for s, e in merged(some):
                    edge = (first > 0 and s <= first - width) or (last < n and e >= last + width)
                    if edge or e - s + q >= max(least, times * q):
                        found.append((q, s, e))
        if width >= len(h):
            break
        h = _doubled(h, width)
        width *= 2
    return found


def tiles(n: int, least: int, times: int, core: int) -> list[tuple[int, int, int, int]]:
    """(first, last, small, large) of the tiles of a document of ``n`` words."""
    base = small = base_block(least, times)
    if n < least:
        return []
    large = base
    while 2 * large * times <= n:
        large *= 2
    if n <= core:
        return [(0, n, base, large)]
    out = []
    while small <= large:
        to = min(large, max(small, core // 8))
        size = max(core, 8 * to)
        out += [(first, min(n, first + size), small, to) for first in range(0, n, size)]
        small = 2 * to
    return out


_SPAN = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_TILE = pa.struct([("n", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
                   ("small", pa.int64()), ("large", pa.int64()), ("codes", pa.binary())])
_READ = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("words", pa.binary()),
                   ("sha", pa.string()), ("found", pa.list_(_SPAN)), ("tiles", pa.list_(_TILE))])
_READ_DDL = ("row long, doc_id long, n long, words binary, sha string, "
             "found array<struct<period:long,start:long,end:long>>, "
             "tiles array<struct<n:long,lo:long,first:long,last:long,small:long,large:long,codes:binary>>")


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def _reader(rewrite: Callable | None, least: int, times: int, core: int, digest: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, raw in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                words = (raw or b"").split()
                if rewrite:
                    words = rewrite(doc_id, words)
                n, found, dealt = len(words), [], []
                plan = tiles(n, least, times, core)
                if plan:
                    known = _Codes()
                    codes = np.fromiter(map(known.__getitem__, words), np.int32, n)
                    if len(plan) == 1:
                        found = solve_tile(codes, n, 0, *plan[0], least, times)
                    else:
                        for first, last, small, large in plan:
                            lo, hi = max(0, first - large), min(n, last + 3 * large)
                            dealt.append((n, lo, first, last, small, large, codes[lo:hi].tobytes()))
                text = b" ".join(words)
                open_ = bool(found or dealt)
                rows.append((row, doc_id, n, text if open_ or not digest else None,
                             None if open_ or not digest else hashlib.sha256(text).hexdigest(),
                             [dict(zip(_SPAN.names, f)) for f in found], [dict(zip(_TILE.names, t)) for t in dealt]))
                row += 1
            if rows:
                yield record_batch(_READ, list(zip(*rows)))
    return read


_FRAGMENT = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FRAGMENT_DDL = "row long, period long, start long, end long"


def _tile_solver(least: int, times: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                codes = np.frombuffer(t["codes"], np.int32)
                out += [(t["row"], *f) for f in solve_tile(codes, t["n"], t["lo"], t["first"], t["last"],
                                                           t["small"], t["large"], least, times)]
            if out:
                yield record_batch(_FRAGMENT, list(zip(*out)))
    return solve


def stitched(fragments: DataFrame, least: int, times: int) -> DataFrame:
    """(row, start, length, period) of whole runs: fragments of one period
    that overlap or touch are one."""
    by = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    island = F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = (opened.withColumn("island", island).groupBy("row", "period", "island")
             .agg(F.min("start").alias("start"), F.max("end").alias("end")))
    length = F.col("end") - F.col("start") + F.col("period")
    return whole.select("row", "start", length.alias("length"), "period").where(
        F.col("length") >= F.greatest(F.lit(least), F.col("period") * times))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run (start, length, period) holds behind its first period."""
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    keep = np.cumsum(marks[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: least start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                  ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                  ("collapsed_sha256", pa.string())])
_OUT_DDL = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
            "runs_sha256 string, collapsed_sha256 string")
_FULL = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct(
    [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_FULL_DDL = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _finisher(digest: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                runs = sorted(((x["start"], x["length"], x["period"]) for x in r["runs"] or []), key=lambda x: (x[0], x[2]))
                text = r["words"]
                if runs:
                    text = b" ".join(collapse(text.split(b" "), runs))
                if not digest:
                    rows.append((r["doc_id"], [dict(zip(("start", "length", "period"), x)) for x in runs],
                                 text.decode("utf-8", "replace")))
                    continue
                sha = r["sha"] or hashlib.sha256(text).hexdigest()
                listed = "".join("%d,%d,%d\n" % x for x in runs)
                best = strongest(runs)
                rows.append((r["doc_id"], len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                             hashlib.sha256(listed.encode()).hexdigest(), sha))
            if rows:
                yield record_batch(_OUT if digest else _FULL, list(zip(*rows)))
    return finish


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                  least: int = LEAST, times: int = TIMES, core: int = CORE, digest: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) of every document: its runs (start, length,
    period; word numbers) by start and period, and its words without those
    that repeat.  ``rewrite`` maps (doc_id, words) to the words to look at.
    ``digest`` returns counts, the strongest run and checksums instead."""
    if times < 3:
        raise ValueError("runs of fewer than three periods need another grid of blocks")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    seen = materialise(map_arrow(slim, _reader(rewrite, least, times, core, digest), _READ_DDL), "periodic-read")
    exploded = seen.where(F.size("tiles") > 0).select("row", F.explode("tiles").alias("t")).select("row", "t.*")
    dealt = exploded.repartition("row", "first", "small")
    here = seen.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    fragments = here.unionByName(map_arrow(dealt, _tile_solver(least, times), _FRAGMENT_DDL))
    runs = (stitched(fragments, least, times).groupBy("row")
            .agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")))
    has_fragments = (F.size("found") > 0) | (F.size("tiles") > 0)
    columns = ["doc_id", "words", "sha", "runs"]
    moved = seen.where(has_fragments).join(runs, "row", "left").select(columns)
    still = seen.where(~has_fragments).withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)).select(columns)
    return map_arrow(still.unionByName(moved), _finisher(digest), _OUT_DDL if digest else _FULL_DDL)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the crc32 of its id, ends in a repetition."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark, sf_dir):
    """Runs of every whole document, after the tails that the contract plants."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted, digest=True)
