import random
import re

import numpy as np
import pytest
import xxhash

from retail_signal.llm import simhash as S
from retail_signal.llm.components import components
from .helpers import frame, odd_rows, prose


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs):
    """Least id reachable for each (id, fingerprint), over all pairs."""
    prints = np.array([f for _, f in pairs], np.uint64)
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a in range(len(pairs)):
        for b in np.flatnonzero(np.bitwise_count(prints[a + 1:] ^ prints[a]) <= 4) + a + 1:
            root[find(int(b))] = find(a)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(pairs))]


@pytest.mark.parametrize("text", ["", " \n", "One two", "a b c d", "A b C d E", prose(300, 1), "É ß \U0001F600 x y", "\x1c\x85a b c d e"])
def test_fingerprint_equals_the_definition(text):
    assert S.fingerprint(text) == fingerprint(text)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = S.op8_simhash_pivots(spark, sf).collect()
    pairs = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [r.component_id for r in got] == classes(pairs)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()}
    assert all(f == fingerprint(docs[i] or "") for i, f in pairs if i in docs)


@pytest.mark.parametrize("limit", [2, 7, 4096])
def test_links_of_crowded_blocks_are_whole(spark, limit):
    """Crowds of fingerprints around a few centres, so that blocks are large."""
    rnd = random.Random(limit)
    prints = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(S.fingerprint_links(df, 4, limit)).collect()}
    want = classes(list(enumerate(prints)))
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({min(g) for g in groups.values()})


def test_pivots_lose_no_link():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2**64, 300, np.uint64)
    x = np.concatenate([x, x ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64)), x ^ np.uint64(0b10111)])
    i, j = S.links_between(x, None, 4)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if bin(int(x[a] ^ x[b])).count("1") <= 4}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(-5, 300), (300, 7000), (9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 180)) and got[7000] == -5
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows_and_empty_tables(spark):
    docs = frame(spark, odd_rows())
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 4), ("5", 4), ("6", 6), ("None", None), ("7", 7), ("8", 8), ("9", 9)])
    left = S.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "6", "7", "8", "9", "None"]
    assert {r.text for r in left.collect()} == {r[1] for r in odd_rows()} - {"", " \n\t "}
    assert S.near_duplicates(frame(spark, [])).count() == 0 and S.deduplicated(frame(spark, [])).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, c), (None, a), (3, None), (4, ""), (None, prose(50, 9)), (7, b + " x")]
    docs = frame(spark, rows)
    for sent in (S.SENT_KEYS, 0):
        for parts in (1, 5):
            left = S.deduplicated(docs.repartition(parts), sent_keys=sent)
            assert left.columns == docs.columns
            got = sorted((str(r.doc_id), r.text or "") for r in left.collect())
            assert got == sorted([("1", a), ("1", b), ("None", c), ("3", ""), ("None", prose(50, 9))])


def test_reruns_choose_the_same_of_rows_equal_in_id_and_text(spark):
    docs = frame(spark, [(1, "one two three four five", "en", s) for s in "abcdefgh"])
    first = {tuple(S.deduplicated(docs.repartition(n)).first()) for n in (1, 3, 8)}
    assert len(first) == 1
