"""Domains over time, learned rules and fusion by domain similarity."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_signal.operators import domains as dm


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_assignment_is_the_cheapest(n):
    rnd = random.Random(n)
    for _ in range(40):
        cost = [[rnd.choice([0.0, rnd.random(), 5.0]) for _ in range(n)] for _ in range(n)]
        got = dm.assignment(cost)
        assert sorted(got) == list(range(n))
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(cost[i][got[i]] for i in range(n)) == pytest.approx(best)


def test_labels_do_not_depend_on_cluster_numbers():
    rnd = random.Random(2)
    base = [[0.0, 0.0], [5.0, 0.0], [0.0, 5.0], [9.0, 9.0]]
    centres = {t: [[x + t * 0.3 + rnd.random() * 0.1 for x in c] for c in base] for t in range(6)}
    want = {t: {tuple(c): label for c, label in zip(cs, dm.align_centres(centres)[t])} for t, cs in centres.items()}
    for _ in range(20):
        shuffled = {t: rnd.sample(cs, len(cs)) for t, cs in centres.items()}
        got = dm.align_centres(shuffled)
        assert {t: {tuple(c): label for c, label in zip(cs, got[t])} for t, cs in shuffled.items()} == want
    for t in range(1, 6):  # the same cluster keeps its label
        for c, d in zip(centres[t - 1], centres[t]):
            assert want[t - 1][tuple(c)] == want[t][tuple(d)]


def test_stores_keep_their_domain_until_they_move(spark):
    rows = []
    for s in range(30):
        for q in range(4):
            level = s % 3 if not (s == 0 and q >= 2) else 2
            for d in range(3):
                rows.append((s, dt.date(2021, 1 + 3 * q, 1 + d), 100.0 * level + s * 0.1 + q, 10.0 * level))
    df = spark.createDataFrame(rows, "store int, date date, a double, b double")
    got = {}
    for seed in (1, 2, 3):
        r = dm.domains_over_time(df, ["a", "b"], k=3, seed=seed)
        assert r.count() == 120
        got[seed] = sorted(map(tuple, r.collect()))
    assert got[1] == got[2] == got[3]
    moves = {(str(r["period"]), r["from_domain"], r["to_domain"]): r["stores"] for r in dm.domain_transitions(r).collect()}
    changed = {k: v for k, v in moves.items() if k[1] != k[2]}
    assert list(changed.values()) == [1] and next(iter(changed))[0] == "2021-07-01"
    assert sum(moves.values()) == 90
    assert dm.domains_over_time(df.limit(0), ["a", "b"]).collect() == []


def test_cut_points_and_intervals(spark):
    df = spark.createDataFrame([(float(i), 1.0, None) for i in range(9)], "a double, b double, c double")
    cuts = dm.cut_points(df, ["a", "b", "c"])
    assert cuts == {"a": [8 / 3, 16 / 3], "b": [1.0], "c": []}
    conditions = dm.interval_conditions(cuts)
    assert list(conditions) == ["a:1", "a:2", "a:3", "b:1", "b:2", "c:1"]
    counts = df.agg(*[F.count_if(F.expr(p)).alias(n) for n, p in conditions.items()]).first().asDict()
    assert counts == {"a:1": 3, "a:2": 3, "a:3": 3, "b:1": 9, "b:2": 0, "c:1": 0}


def test_mined_rules_are_checked_as_predicates(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(400):
        a = rnd.random()
        rows.append((k % 5, dt.date(2020, 1, 1), a, a * 2 + rnd.random() * 0.2, rnd.random()))
    df = spark.createDataFrame(rows, "store int, date date, a double, b double, c double")
    conditions = dm.interval_conditions(dm.cut_points(df, ["a", "b", "c"]))
    baskets = dm.transaction_items(df, conditions)
    rules = dm.mine_rules(baskets, 0.1, 0.5)
    mined = {f"{' & '.join(sorted(r['antecedent']))} => {' & '.join(sorted(r['consequent']))}": r for r in rules.collect()}
    got = dm.mine_and_check(df, conditions, "store", 0.1, 0.5, top=6)
    total = got.groupBy("rule_id").agg(F.sum("n_antecedent").alias("a"), F.sum("n_both").alias("both"), F.sum("violations").alias("v")).collect()
    assert len(total) == 6
    for r in total:
        rule = mined[r["rule_id"]]
        assert r["both"] / r["a"] == pytest.approx(rule["confidence"]) and r["both"] / 400 == pytest.approx(rule["support"])
        assert r["a"] - r["both"] == r["v"]
    assert any("a:" in k and "b:" in k for k in (r["rule_id"] for r in total))
    assert dm.mine_and_check(df, conditions, "store", 0.99, 0.99).collect() == []


def test_fusion_equals_its_formula(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        d = "abc"[k % 3]
        x = rng.normal(10 * "abc".index(d), 2)
        rows.append((k, dt.date(2020, 1, 1), d, float(x), float(3 + (1 + "abc".index(d)) * x + rng.normal())))
    rows.append((300, dt.date(2020, 1, 1), "a", None, 1.0))
    df = spark.createDataFrame(rows, "store int, date date, domain string, x double, y double")
    fit = dm.domain_regressors(df, "y", "x")
    sims = dm.domain_similarities(df, ["x", "y"])
    fused = {r["store"]: r for r in dm.fuse_predictions(dm.source_predictions(df, fit, "x", ["store", "date"]), sims, ["store"], ["domain", "source"]).collect()}
    data = [r for r in rows if r[3] is not None]
    X, Y = np.array([r[3] for r in data]), np.array([r[4] for r in rows])
    lines = {d: np.polyfit([r[3] for r in data if r[2] == d], [r[4] for r in data if r[2] == d], 1) for d in "abc"}
    z = {d: np.array([np.mean([(r[3] - X.mean()) / X.std(ddof=1) for r in data if r[2] == d]),
                      np.mean([(r[4] - Y.mean()) / Y.std(ddof=1) for r in rows if r[2] == d])]) for d in "abc"}
    assert len(fused) == 300 and {(r["domain"], r["source"]) for r in sims.collect()} == set(itertools.product("abc", "abc"))
    for k in (0, 1, 2, 77, 299):
        d, x = rows[k][2], rows[k][3]
        w = {s: np.exp(-((z[d] - z[s]) ** 2).sum()) for s in "abc"}
        want = sum(w[s] * np.polyval(lines[s], x) for s in "abc") / sum(w.values())
        assert fused[k]["y_hat_fused"] == pytest.approx(want) and fused[k]["n_domains"] == 3
