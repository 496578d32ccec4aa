"""Phrase collocations: the filter is lossless, the query equals brute force and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from retail_signal.llm import collocations, quotient
from retail_signal.llm.collocations import collocations as mine
from retail_signal.llm.collocations import dense_ids, gram_counts, tokens
from tests.llm.helpers import frame, odd_rows, prose

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("id_bits,words", [(4, 2), (17, 3), (21, 3), (22, 3), (32, 3), (42, 3), (31, 4)])
def test_filter_gives_back_every_entry(id_bits, words):
    rnd = random.Random(id_bits)
    packing = quotient.Packing(id_bits, words)
    grams = [[rnd.randrange(1, 1 << id_bits) if i < size else 0 for i in range(words)]
             for size in [rnd.randint(2, words) for _ in range(3000)]]
    grams += grams[:50] * 20 + [grams[0]] * 700
    ids = [np.array(c, np.uint64) for c in zip(*grams)]
    hi, lo = packing.permute(*packing.pack(ids))
    assert int(hi.max()) < 1 << packing.half and int(lo.max()) < 1 << packing.half
    hi, lo, n = quotient.summed(packing.half, hi, lo)
    found = Counter()
    for which, raw in quotient.slices(packing.half, 3, hi, lo, n):
        h, low, m = quotient.decode(raw)
        assert ((h >> np.uint64(packing.half - 3)) == which).all()
        for gram, k in zip(zip(*packing.unpack(*packing.restore(h, low))), m.tolist()):
            found[tuple(int(x) for x in gram)] += k
    assert found == Counter(map(tuple, grams))


def test_filters_are_compact_and_merge():
    packing = quotient.Packing(17, 3)
    rnd = np.random.default_rng(1)
    parts, want = [], Counter()
    for _ in range(9):
        ids = [rnd.integers(1, 40, 5000).astype(np.uint64) for _ in range(3)]
        want.update(zip(*(x.tolist() for x in ids)))
        hi, lo, n = quotient.summed(packing.half, *packing.permute(*packing.pack(ids)))
        raw = quotient.encode(packing.half, 0, 0, hi, lo, n)
        assert len(raw) < 9 * len(hi)
        parts.append(raw)
    merger = quotient.Merger()
    for raw in parts:
        merger.add(raw)
    hi, lo, n = merger.result()
    got = dict(zip(zip(*(x.tolist() for x in packing.unpack(*packing.restore(hi, lo)))), n.tolist()))
    assert got == want
    empty = quotient.encode(packing.half, 2, 1, hi[:0], lo[:0], n[:0])
    assert len(quotient.decode(empty)[0]) == 0


def brute(rows, max_words=3, least=10, cover=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[key] = f.get(key := (lang, *words[i:i + k]), 0) + 1
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    drop = set()
    for g, a in cand.items():
        for size in range(2, len(g) - 1):
            for i in range(1, len(g) - size + 1):
                sub = (g[0], *g[i:i + size])
                if 100 * a >= cover * cand[sub]:
                    drop.add(sub)
    out = {}
    for g, a in cand.items():
        if g not in drop:
            lang, w = g[0], g[1:]
            cuts = []
            for k in range(1, len(w)):
                left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top]))


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_tokens():
    assert tokens("Ab\tC. d,,É  É\r\nx".encode()) == [b"ab", b"c", b"\n", b"d", b"\n", b"\n", "É".encode(), "É".encode(), b"\n", b"\n", b"x"]
    assert tokens(b"") == []


@pytest.mark.parametrize("max_words,shard_words,slice_entries", [(3, 50, 16), (2, 2_000, 1 << 20), (4, 500, 64)])
def test_equals_brute_force_in_many_shards_and_slices(spark, max_words, shard_words, slice_entries):
    rnd = random.Random(3)
    rows = [(rnd.choice(["en", "en", "de", None]),
             ("New York! " if rnd.random() < 0.3 else "") + prose(rnd.randint(0, 60), rnd.randint(0, 40)) + rnd.choice(["", ". a\x01b A b c", ",\ta b c d"]))
            for _ in range(150)] + [(None, None), ("fr", ""), ("fr", " . ")]
    docs = frame(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)])
    for least, cover, top in ((10, 50, 2000), (2, 90, 7)):
        got = rows_of(mine(docs, max_words, least, cover, top, shard_words=shard_words, slice_entries=slice_entries))
        assert got == brute(rows, max_words, least, cover, top) and got


def test_repeats_odd_rows_and_empty_table(spark):
    odd = odd_rows() * 10
    docs = frame(spark, odd)
    want = brute([(r[2] if len(r) > 2 else None, r[1]) for r in odd])
    assert rows_of(mine(docs)) == want and want
    assert mine(docs.limit(0)).collect() == []


def test_ids_are_dense(spark):
    words = spark.range(5000).selectExpr("concat('w', id) AS word", "'en' AS lang", "10L AS f")
    ids = sorted(r["id"] for r in dense_ids(words, ["lang", "word"]).collect())
    assert ids == list(range(1, 5001))


def test_counts_of_a_huge_gram_pass_one_byte(spark):
    docs = frame(spark, [(i, "a b " * 500) for i in range(3)])
    words, counts, totals = gram_counts(docs, 2)
    names = {r["id"]: r["word"].decode() for r in words.collect()}
    assert {tuple(names[i] for i in r["gram"]): r["f"] for r in counts.collect()} == {("a", "b"): 1500, ("b", "a"): 1497}
    assert [tuple(r) for r in totals.collect()] == [("und", 3000)]


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 5_000_000_000_000, 4_000_000_000_000)], "a long, l long, r long")
    got = df.select(collocations._score(df["a"], df["l"], df["r"])).first()[0]
    assert got == 1_000_000 * 3 * 3 // 20
