"""Packing: exact ids, every id once, full sequences, and the plan against brute force."""

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retail_signal.llm import packing
from retail_signal.llm.packing import ChunkEncoder, fill, packed, plan
from tests.llm.helpers import frame, odd_rows, prose

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_remembered_chunks_give_the_ids_of_whole_texts(spark):
    odd = ["", " ", "  ", "a  b", "a \n b", "\n\n a", "tab\t\tx  ", "x\x1c \x1cy", "it's  we'll 's",
           "\x85a\xa0  b  c​ d᠎ e", "<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|",
           "naïve 12,345.6 été 漢字 \U0001F600\U0001F600", "a　b 　 c", "\r\nx\r\n", "é" * 3000, "\x00 \x00"]
    rnd = random.Random(1)
    odd += ["".join(rnd.choice(" \n\t\xa0\x1f　 a1.'é") for _ in range(60)) for _ in range(400)]
    odd += [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    mine, tokenizer = ChunkEncoder(PATH, limit=50), Tokenizer.from_file(PATH)
    want = [e.ids for e in tokenizer.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):
        got = [np.frombuffer(x, mine.dtype).tolist() for x in mine(odd)]
        assert got == want
    assert [np.frombuffer(x, mine.dtype).tolist() for x in ChunkEncoder(PATH, by_chunk=False)(odd[:30])] == want[:30]


def test_fill_is_the_closest_sum():
    rnd = random.Random(2)
    for _ in range(300):
        window = rnd.choice([16, 31, 64])
        pieces = [rnd.randrange(1, window) for _ in range(rnd.randint(1, 9))]
        counts = {n: pieces.count(n) for n in pieces}
        used = fill(sorted(counts, reverse=True), counts, window)
        longest = max(pieces)
        others = list(pieces)
        others.remove(longest)
        best = max(longest + sum(c) for k in range(len(others) + 1) for c in combinations(others, k) if longest + sum(c) <= window)
        assert sum(n * k for n, k in used.items()) == best
        assert used[longest] >= 1 and all(counts[n] >= k for n, k in used.items())


@pytest.mark.parametrize("window,histogram", [
    (1024, {}), (1024, {1: 1}), (1024, {700: 1}), (1024, {700: 100_001}), (1024, {1023: 5}), (1024, {1: 10_000_000}),
    (1024, {n: 1 + n * 7919 % 1000 for n in range(1, 1024)}), (1024, {n: 10**9 + n for n in range(1, 1024)}),
    (64, {33: 10, 63: 3}), (7, {3: 5, 6: 4}), (1024, {513: 1000, 512: 3, 2: 1})])
def test_plan_places_every_token_once(window, histogram):
    lines, sequences = plan(histogram, window)
    assert len(lines) < 60 * window
    total = sum(n * k for n, k in histogram.items())
    assert sum((high - low) * size for _, low, high, _, size, _, _ in lines) == total
    full, rest = divmod(total, window)
    assert sequences == full + bin(rest).count("1")
    if total > 10**6:
        return
    seen, filled = {}, {}
    for tail, low, high, start, size, sequence, offset in lines:
        for rank in range(low, high):
            seen.setdefault((tail, rank), []).append((start, size))
            filled.setdefault(sequence + rank - low, []).append((offset, size))
    assert len(seen) == sum(histogram.values())
    for (tail, _), parts in seen.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at and size > 0
            at += size
        assert at == tail
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == window or at & (at - 1) == 0
    assert sorted(filled) == list(range(sequences))


def test_most_tails_stay_whole():
    rnd = random.Random(4)
    tails = [rnd.randrange(1, 1024) for _ in range(20_000)]
    lines, _ = plan({n: tails.count(n) for n in set(tails)})
    cuts = sum(high - low for _, low, high, *_ in lines) - len(tails)
    assert cuts < 0.06 * len(tails)


def check(rows, texts, window, end=0):
    """Every document's ids in order, gapless sequences, full but for powers of two."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (end,)) for t in texts)
    sequences, total = {}, 0
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
        assert r["length"] > 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == window or (at < window and at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    assert total == sum(map(len, want))
    return want


@pytest.mark.parametrize("window", [1024, 16])
def test_round_trip_over_many_tasks(spark, window):
    texts = [prose(n, n) for n in range(1, 120)] + [prose(50, 3)] * 40 + [None, "", "<|endoftext|> x", prose(9000, 1)]
    docs = frame(spark, list(enumerate(texts))).repartition(5)
    rows = packed(docs, PATH, window=window).collect()
    check(rows, texts, window)
    tokenizer, by = Tokenizer.from_file(PATH), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        parts = sorted(by[i], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(ids) for r in parts)
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts[:-1])]).tolist()


def test_odd_rows_repeats_and_empty_table(spark):
    docs = frame(spark, odd_rows())
    check(packed(docs, PATH).collect(), [r[1] for r in odd_rows()], 1024)
    assert packed(docs.limit(0), PATH).collect() == []


def test_query(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(packing.op13_slack_packing(spark, SF).collect(), texts, 1024)
