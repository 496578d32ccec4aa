"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random

import numpy as np
import pytest

from retail_signal.llm import periodic
from retail_signal.llm.periodic import base_block, periodic_runs, planted, solve_tile, tiles, z_function
from tests.llm.helpers import frame, odd_rows

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    n, codes = len(words), {}
    a = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    runs, smallest = [], {}
    for q in range(1, n // times + 1):
        same = np.concatenate([[False], a[:n - q] == a[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = e - s + q
            if length >= max(least, times * q):
                if any(q % d == 0 and all(x == y for x, y in zip(words[s:s + q - d], words[s + d:s + q]))
                       for d in range(1, q // 2 + 1)):
                    continue
                runs.append((s, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def texts():
    rnd = random.Random(5)
    out = []
    for i in range(120):
        words = []
        while len(words) < rnd.choice([20, 60, 200, 900, 2500]):
            p = rnd.choice([1, 2, 3, 5, 8, 13, 40, 130, 300])
            block = [rnd.choice("abc" if i % 3 else "abcdefghijklmnopqrstuvw") for _ in range(p)]
            words += (block * rnd.randint(1, 9))[:rnd.randint(1, 9 * p)]
        out.append(words)
    out += [["x"] * 5000, ["x", "y"] * 3000, ["z"] * 23, ["z"] * 24, []]
    return out


def test_z_function():
    assert z_function(list("aabaaab")) == [7, 1, 0, 2, 3, 1, 0]
    assert z_function([]) == []


def test_base_block_serves_every_period_below_twice_its_width():
    assert base_block(24, 3) == 8
    for least, times in ((24, 3), (9, 3), (100, 4), (3, 3)):
        w = base_block(least, times)
        assert all(max(least - q, (times - 1) * q) >= 2 * w - 1 for q in range(1, 2 * w)) or w == 1


@pytest.mark.parametrize("core", [64, 512, 4096])
def test_equals_brute_force_for_every_tile_size(spark, core):
    found = texts()
    docs = frame(spark, [(i, " ".join(w)) for i, w in enumerate(found)])
    got = {r["doc_id"]: r for r in periodic_runs(docs, core=core).collect()}
    for i, words in enumerate(found):
        want = brute(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, i
        drop = set()
        for s, length, q in want:
            drop.update(range(s + q, s + length))
        assert got[i]["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in drop)


def test_tiles_cover_every_block_once():
    for n in (24, 4096, 4097, 50_000, 300_000):
        at = {}
        for first, last, small, large in tiles(n, 24, 3, 4096):
            w = small
            while w <= large:
                at.setdefault(w, []).append((first, last))
                assert first % w == 0
                w *= 2
        assert all(sorted(x)[0][0] == 0 and sorted(x)[-1][1] == n for x in at.values())
        assert all(a[1] == b[0] for x in at.values() for a, b in zip(sorted(x), sorted(x)[1:]))
        assert 3 * 2 * max(at) > n - 3 or max(at) * 6 > n


def test_a_long_period_crosses_many_tiles(spark):
    rnd = random.Random(1)
    block = [str(rnd.random()) for _ in range(9_000)]
    words = ["a", "b"] * 10 + block * 4 + ["c"]
    docs = frame(spark, [(1, " ".join(words))])
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(20, 36_000, 9_000)]


def test_solver_leaves_no_short_fragment_inside_a_tile():
    codes = np.array([0, 1] * 5 + list(range(2, 200)), np.int32)
    assert solve_tile(codes, len(codes), 0, 0, len(codes), 8, 64, 24, 3) == []


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d["doc_id"], (d["text"] or "").encode().split())
        runs = brute(words)
        r = got[d["doc_id"]]
        some += bool(runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        drop = set()
        for s, length, q in runs:
            drop.update(range(s + q, s + length))
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert some > 10


def test_odd_rows_repeats_and_empty_table(spark):
    docs = frame(spark, odd_rows())
    got = periodic_runs(docs, digest=True).collect()
    assert len(got) == len(odd_rows())
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (1, 2, 3, 9)}
    assert all(by[i]["collapsed_sha256"] == empty and by[i]["n_runs"] == 0 and by[i]["start"] is None for i in (1, 2, 3))
    assert (by[9]["n_runs"], by[9]["start"], by[9]["length"], by[9]["period"]) == (1, 0, 20_000, 1)
    assert periodic_runs(docs.limit(0), planted, digest=True).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, times=2)
