"""Counting quotient filters of packed n-grams of word ids, without loss.

An n-gram of ids (1 and up; 0: no word) is packed into 2 * half bits, which an
invertible permutation (a Feistel network of three rounds) spreads evenly.
The top bits of what comes out are the quotient, all the others the remainder,
so a filter gives back every n-gram exactly: it is a counter table, not a
sketch.  Stored are

    the lengths of the runs of equal quotients, in unary (a 0 bit an entry,
    a 1 bit a quotient), so a quotient costs about two bits an entry;
    the remainders, in as few whole bytes as they need;
    the counters, one byte each, those of 255 and more in a list behind.

Entries are sorted by quotient and remainder, so filters of shards merge like
sorted runs, and a slice, the entries whose quotient starts with given bits,
is a filter of its own: slices are what a shuffle deals out.
"""

from __future__ import annotations

import struct

import numpy as np

U = np.uint64
_KEYS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
_HEAD = struct.Struct("<BBBxIII")  # half, slice bits, quotient bits, slice, entries, large counters


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = x + key
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Packing:
    """n-grams of up to ``words`` ids of ``id_bits`` bits as two halves."""

    def __init__(self, id_bits: int, words: int):
        self.id_bits, self.words = id_bits, words
        self.half = max(8, -(-id_bits * words // 2))
        if id_bits > 63 or self.half > 63:
            raise ValueError("an n-gram has 126 bits at most")
        self.mask = U((1 << self.half) - 1)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hi, lo = np.zeros(len(ids[0]), U), np.zeros(len(ids[0]), U)
        for k, g in enumerate(ids):
            g, at = g.astype(U), k * self.id_bits
            if at >= self.half:
                hi |= g << U(at - self.half)
                continue
            lo |= (g << U(at)) & self.mask
            if at + self.id_bits > self.half:
                hi |= g >> U(self.half - at)
        return hi, lo

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        out, one = [], U((1 << self.id_bits) - 1)
        for k in range(self.words):
            at = k * self.id_bits
            if at >= self.half:
                g = hi >> U(at - self.half)
            else:
                g = lo >> U(at)
                if at + self.id_bits > self.half:
                    g = g | hi << U(self.half - at)
            out.append((g & one).astype(np.int64))
        return out

    def permute(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in _KEYS:
            hi, lo = lo, hi ^ (_mix(lo, key) & self.mask)
        return hi, lo

    def restore(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in reversed(_KEYS):
            hi, lo = lo ^ (_mix(hi, key) & self.mask), hi
        return hi, lo


def summed(half: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (hi, lo), equal ones added up.  Runs that are sorted already
    are merged (the stable sort of NumPy finds them)."""
    if not len(hi):
        return hi, lo, np.zeros(0, np.int64)
    if 2 * half <= 64:
        key = hi << U(half) | lo
        if n is None:
            key.sort(kind="stable")
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        kept = key[first]
        hi, lo = kept >> U(half), kept & U((1 << half) - 1)
    else:
        order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], None if n is None else n[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        total = len(hi)
        hi, lo = hi[first], lo[first]
        return hi, lo, np.diff(np.append(first, total)) if n is None else np.add.reduceat(n, first)
    return hi, lo, np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first)


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].tobytes()


def _values_of(raw: memoryview, entries: int, bits: int) -> np.ndarray:
    out = np.zeros((entries, 8), np.uint8)
    out[:, :-(-bits // 8)] = np.frombuffer(raw, np.uint8).reshape(entries, -(-bits // 8))
    return out.view("<u8").reshape(entries).astype(U)


def encode(half: int, slice_bits: int, which: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """The filter of slice ``which``: entries sorted, without equal ones."""
    entries = len(hi)
    bits = min(half, slice_bits + max(0, entries - 1).bit_length())
    rest = half - bits
    quotient = (hi >> U(rest)).astype(np.int64) - (which << (bits - slice_bits))
    slots = 1 << (bits - slice_bits)
    unary = np.zeros(entries + slots, bool)
    runs = np.bincount(quotient, minlength=slots)
    unary[np.cumsum(runs) + np.arange(slots)] = True
    part = hi & U((1 << rest) - 1)
    if rest + half <= 64:
        remainders = _bytes_of(part << U(half) | lo, rest + half)
    else:
        remainders = _bytes_of(part, rest) + _bytes_of(lo, half)
    large = n >= 255
    return b"".join((_HEAD.pack(half, slice_bits, bits, which, entries, int(large.sum())), np.packbits(unary).tobytes(),
                     remainders, np.where(large, 255, n).astype(np.uint8).tobytes(), n[large].astype("<i8").tobytes()))


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, n) of a filter, sorted."""
    half, slice_bits, bits, which, entries, large = _HEAD.unpack_from(raw)
    data, at = memoryview(raw), _HEAD.size
    slots, rest = 1 << (bits - slice_bits), half - bits
    size = -(-(entries + slots) // 8)
    unary = np.unpackbits(np.frombuffer(data[at:at + size], np.uint8), count=entries + slots)
    at += size
    quotient = np.cumsum(unary)[unary == 0].astype(U) + U(which << (bits - slice_bits))
    if rest + half <= 64:
        size = entries * -(-(rest + half) // 8)
        both = _values_of(data[at:at + size], entries, rest + half)
        part, lo = both >> U(half), both & U((1 << half) - 1)
    else:
        size = entries * -(-rest // 8)
        part = _values_of(data[at:at + size], entries, rest)
        at, size = at + size, entries * -(-half // 8)
        lo = _values_of(data[at:at + size], entries, half)
    at += size
    n = np.frombuffer(data[at:at + entries], np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(data[at + entries:at + entries + 8 * large], "<i8")
    return quotient << U(rest) | part, lo, n


def slices(half: int, slice_bits: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray):
    """(slice, filter) of the slices that have entries."""
    top = (hi >> U(half - slice_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(top)]):
        which = int(top[a])
        yield which, encode(half, slice_bits, which, hi[a:b], lo[a:b], n[a:b])


class Merger:
    """Adds up the filters of one slice, a few at a time: what waits is merged
    once it is as long as what is merged already."""

    def __init__(self):
        self.half, self.waiting, self.entries, self.merged = 0, [], 0, 0

    def add(self, raw: bytes) -> None:
        self.half = raw[0]
        self.waiting.append(decode(raw))
        self.entries += len(self.waiting[-1][0])
        if self.entries > 2 * self.merged + (1 << 18):
            self._merge()

    def _merge(self) -> None:
        hi, lo, n = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = [summed(self.half, hi, lo, n)]
        self.entries = self.merged = len(self.waiting[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._merge()
        return self.waiting[0]
