"""Documents packed into sequences of a fixed number of tokens, by minimum bin slack.

A document's ids and its end id fill whole windows first; what is left over,
its tail, is shorter than a window and wants company.

1. Texts are encoded once and written with their place: the task, and how many
   tails of the same length that task wrote before.
2. The tails are a multiset of fewer than ``window`` lengths, so a histogram
   says all there is to plan, whatever the size of the corpus.  On it runs
   minimum bin slack: the longest tail opens a window, a subset-sum over a
   bitset (one integer, a bit for each sum that can be reached) finds the sum
   closest to the window, and going back through its steps gives how many tails
   of each length to take.  That pattern is used as often as the counts allow.
   Where no sum fills the window, one more tail is cut to fill it and its rest
   goes back to the multiset.  The very last window is cut into powers of two.
3. The plan says for each length which of its tails, by rank, go to which
   sequences.  A tail's rank is its place in its task plus the tails of that
   length in earlier tasks, a running sum of counts.

So sequences are full but for the last, most tails stay whole, and a length
that a third of all documents share is only a larger count.  The plan's size
depends on ``window`` alone; tokens move once, by (task, tail length), to meet
the running sums.

Defined results: a null or empty text is the end id alone; repeated and null
ids are documents of their own; an empty table packs to no piece; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, record_batch, table

WINDOW = 1024
END_ID = 0


# ------------------------------------------------------------------ encoding

#: White space by Unicode's White_Space property.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Where a byte-level pre-tokenizer always cuts: a space belongs to what
#: follows it, other white space to itself, and letters end before a sign.
_CHUNK = re.compile(f" ?[{_LATIN}]+(?=[\x00-@\\[-`{{-\x7f]|\\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class ChunkEncoder:
    """Ids of texts as bytes under a byte-level tokenizer, by remembered
    chunks; a text that may hold a special token is encoded whole."""

    def __init__(self, path: str, limit: int = 500_000, by_chunk: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_chunk, self.limit, self.known = by_chunk, limit, {}
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks.  Those without a line feed are encoded many at a
        time, a line each: the feed is a token of its own, so ids part again."""
        out: list = [None] * len(chunks)
        lines = [i for i, c in enumerate(chunks) if self.feed is not None and not c.isspace()]
        for k in range(0, len(lines), 1000):
            at = lines[k:k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([chunks[i] for i in at])], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids))
            if len(ends) != len(at):
                raise ValueError("the tokenizer does not cut chunks where this encoder does")
            raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for i, end in zip(at, (ends * size).tolist()):
                out[i] = raw[start:end]
                start = end + size
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encode([chunks[i] for i in rest])):
            out[i] = ids
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.by_chunk or self.special.search(t)]
        plain = [_CHUNK.findall(t) for t in texts]
        for i in whole:
            plain[i] = []
        seen = set().union(*plain)
        missing = list(seen.difference(self.known))
        if len(self.known) + len(missing) > self.limit:  # keep what is in use
            self.known = {c: self.known[c] for c in seen.intersection(self.known)}
        self.known.update(zip(missing, self._learn(missing)))
        out = [b"".join(map(self.known.__getitem__, p)) for p in plain]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = ids
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, by_chunk: bool) -> ChunkEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    key = (path, by_chunk)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, by_chunk=by_chunk)
    return _ENCODERS[key]


# ---------------------------------------------------------------------- plan

#: Of one line: tails of length ``tail`` and rank in [low, high) put their
#: ``size`` ids from ``start`` on at ``offset`` of sequence + rank - low.
LINE = ("tail", "low", "high", "start", "size", "sequence", "offset")


def fill(lengths: list[int], counts: dict[int, int], window: int) -> dict[int, int]:
    """How many of each length fill a window closest, the longest among them.
    ``lengths``: those with a count, longest first."""
    longest = lengths[0]
    reached, steps, mask, full = 1 << longest, [], (1 << (window + 1)) - 1, 1 << window
    for length in lengths:
        room = min(counts[length] - (length == longest), (window - longest) // length)
        take = 1
        while room > 0 and not reached & full:
            k = min(take, room)
            steps.append((length, k, reached))
            reached |= (reached << length * k) & mask
            room -= k
            take *= 2
        if reached & full:
            break
    at, used = reached.bit_length() - 1, {longest: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


class Stock:
    """Tails by present length: runs of ranks of an original length."""

    def __init__(self, histogram: dict[int, int]):
        self.runs = {n: deque([(n, 0, count, 0)]) for n, count in histogram.items() if count}
        self.counts = {n: count for n, count in histogram.items() if count}

    def put(self, length: int, run: tuple) -> None:
        self.runs.setdefault(length, deque()).append(run)
        self.counts[length] = self.counts.get(length, 0) + run[2] - run[1]

    def take(self, length: int, n: int) -> list[tuple]:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
        out = []
        while n:
            tail, low, high, start = self.runs[length].popleft()
            if high - low > n:
                self.runs[length].appendleft((tail, low + n, high, start))
                high = low + n
            out.append((tail, low, high, start))
            n -= high - low
        return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """(lines, number of sequences) for so many tails of each length below
    ``window``."""
    stock, lines, sequence = Stock(histogram), [], 0
    lengths = sorted(stock.counts, reverse=True)

    def place(runs: list[tuple], size: int, offset: int) -> None:
        at = sequence
        for tail, low, high, start in runs:
            lines.append((tail, low, high, start, size, at, offset))
            at += high - low

    while stock.counts:
        lengths = [n for n in lengths if n in stock.counts]
        used = fill(lengths, stock.counts, window)
        slack = window - sum(n * k for n, k in used.items())
        cut = None
        if slack:
            # All that is left is longer than the gap, or it would be in it.
            rest = [n for n in lengths if stock.counts[n] > used.get(n, 0)]
            if not rest:
                sequence = _last(stock, used, lines, sequence)
                break
            cut = max(rest, key=lambda n: (stock.counts[n] - used.get(n, 0), n))
        times = min(stock.counts[n] // (used.get(n, 0) + (n == cut)) for n in {*used, *([cut] if cut else [])})
        offset = 0
        for n in sorted(used, reverse=True):
            for _ in range(used[n]):
                place(stock.take(n, times), n, offset)
                offset += n
        if cut:
            runs = stock.take(cut, times)
            place(runs, slack, offset)
            for tail, low, high, start in runs:
                stock.put(cut - slack, (tail, low, high, start + slack))
            if cut - slack not in lengths:
                lengths = sorted({*lengths, cut - slack}, reverse=True)
        sequence += times
    return lines, sequence


def _last(stock: Stock, used: dict[int, int], lines: list[tuple], sequence: int) -> int:
    """The last window, which cannot be filled: sequences of powers of two."""
    pieces = [(run, n) for n in sorted(used, reverse=True) for _ in range(used[n]) for run in stock.take(n, 1)]
    total = sum(n for _, n in pieces)
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    offset = 0
    for (tail, low, high, start), n in pieces:
        while n:
            size = min(n, sizes[0] - offset)
            lines.append((tail, low, high, start, size, sequence, offset))
            start, n, offset = start + size, n - size, offset + size
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0
    return sequence


# --------------------------------------------------------------------- Spark

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("tail", pa.int64()),
                      ("part", pa.int64()), ("nth", pa.int64()), ("before", pa.int64())])
_ENCODED_DDL = "doc_id long, ids binary, doc_tokens long, tail long, part long, nth long, before long"


def _encoder(tokenizer: str, end_id: int, window: int, by_chunk: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tails, windows = TaskContext.get().partitionId(), {}, 0
        to_ids = encoder(tokenizer, by_chunk)
        end, width = np.array([end_id], to_ids.dtype).tobytes(), to_ids.dtype.itemsize
        for batch in batches:
            rows = []
            found = to_ids([t or "" for t in column(batch, "text").to_pylist()])
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), found):
                n = len(ids) // width + 1
                tail = n % window
                nth = tails.get(tail, 0)
                tails[tail] = nth + 1
                rows.append((doc_id, ids + end, n, tail, part, nth, windows))
                windows += n // window
            if rows:
                yield record_batch(_ENCODED, list(zip(*rows)))
    return encode


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cutter(lines: list[tuple], planned: int, window: int, with_ids: bool):
    schema = _PIECE.append(pa.field("ids", pa.binary())) if with_ids else _PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_tail: dict[int, list] = {}
        for line in lines:
            by_tail.setdefault(line[0], []).append(line)
        by_tail = {k: np.array(v, np.int64) for k, v in by_tail.items()}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw, n = r["ids"], r["doc_tokens"]
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                first = planned + r["windows_base"] + r["before"]
                pieces = [(k * window, window, first + k, 0) for k in range(n // window)]
                if r["tail"]:
                    rank, table_ = r["rank_base"] + r["nth"], by_tail[r["tail"]]
                    mine = table_[(table_[:, 1] <= rank) & (rank < table_[:, 2])]
                    pieces += [(n - r["tail"] + start, size, sequence + rank - low, offset)
                               for _, low, _, start, size, sequence, offset in sorted(mine.tolist(), key=lambda x: x[3])]
                for start, size, sequence, offset in pieces:
                    own = ids[start:start + size]
                    rows.append((r["doc_id"], start, size, zlib.crc32(own), n, sequence, offset)
                                + ((own.tobytes(),) if with_ids else ()))
            if rows:
                yield record_batch(schema, list(zip(*rows)))
    return cut


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, by_chunk: bool = True,
           with_ids: bool = True) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids as little-endian unsigned 32-bit numbers]).
    Sequence ids run from 0 without gaps.  ``by_chunk`` holds for byte-level
    tokenizers; others encode whole texts."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    encoded = materialise(map_arrow(slim, _encoder(tokenizer, end_id, window, by_chunk), _ENCODED_DDL), "packing-ids")
    counts = encoded.groupBy("part", "tail").agg(F.count("*").alias("n"),
                                                 F.sum(F.floor(F.col("doc_tokens") / window)).alias("windows"))
    counts = materialise(counts, "packing-counts")
    histogram = {r["tail"]: r["n"] for r in counts.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    lines, planned = plan(histogram, window)

    def earlier(value: str, *by: str):
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    per_part = counts.groupBy("part").agg(F.sum("windows").alias("windows")).withColumn("all", F.lit(1))
    whole = per_part.select("part", earlier("windows", "all").alias("windows_base"))
    bases = counts.select("part", "tail", earlier("n", "tail").alias("rank_base")).join(whole, "part")
    placed = encoded.join(bases, ["part", "tail"])
    ddl = _PIECE_DDL + (", ids binary" if with_ids else "")
    return map_arrow(placed, _cutter(lines, planned, window, with_ids), ddl)


def op13_slack_packing(spark, sf_dir):
    """All documents as sequences of 1,024 byte_bpe_50k ids."""
    import public_tokenizers
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
