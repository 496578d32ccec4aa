import re
from collections import Counter
from math import comb

import numpy as np
from pyspark.sql import functions as F

from retail_signal.llm import rules as R
from .helpers import frame, odd_rows


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in R.op9_risk_rules(spark, sf).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_binomial_bound_is_exact():
    for n in (1, 5, 40, 200):
        for k in range(0, min(n, 12)):
            for p in (0.005, 0.05, 0.3):
                cdf = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                for limit in (0.001, 0.05, 0.4):
                    if abs(cdf - limit) > 1e-9 and k < n * p:
                        assert R.binomial_cdf_at_most(k, n, p, limit) == (cdf <= limit)
    assert not R.binomial_cdf_at_most(0, 0, 0.1, 0.05)


def test_false_rejections_stay_within_the_risk():
    """Cutoffs from one draw, judged on the distribution they came from."""
    rnd, alpha, delta, failures = np.random.default_rng(2), 0.05, 0.1, 0
    true = np.array([0.6, 0.2, 0.1, 0.05, 0.02, 0.02, 0.01])
    for _ in range(300):
        cut = R.certified_cutoff(rnd.multinomial(300, true), alpha, delta)
        failures += cut is not None and true[cut + 1:].sum() > alpha
    assert failures / 300 <= delta


def test_strata_with_few_labels_keep_what_the_base_keeps(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    stats = R.counts(frame(spark, odd_rows()))
    got = R.verdicts(stats, R.cutoffs(stats, labels)).collect()
    assert len(got) == len(odd_rows()) and all(r.kept == (not r.base_failed) for r in got)


def test_certified_rules_reject_and_clean_documents_stay(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(2500)]
    junk = [(9000 + i, " ".join(f"w{i}x{j}***" for j in range(30)), "en") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2500)], "doc_id long, quality int, toxic int")
    stats = R.counts(frame(spark, clean + junk))
    got = R.verdicts(stats, R.cutoffs(stats, labels))
    assert got.where("doc_id < 9000 and kept").count() == 2500 and got.where("doc_id >= 9000 and kept").count() == 0


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = R.counts(frame(spark, []))
    assert R.verdicts(stats, R.cutoffs(stats, labels)).where(F.col("kept")).count() == 0


def test_verdicts_equal_brute_force(spark):
    """Path, certificate and decision over again, on plain lists."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = R.materialise(R.counts(spark.read.parquet(f"{sf}/documents.parquet")), "t")
    spec = R.RiskSpec()
    cuts = R.cutoffs(stats, labels, spec)
    got = {r.doc_id: r.kept for r in R.verdicts(stats, cuts).collect()}
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").collect()}
    groups = {}
    for r in stats.collect():
        groups.setdefault(r.stratum, []).append(r)
    certified = {r.c_stratum: r.cutoff for r in cuts.collect()}
    assert set(certified) == set(groups) and all(c is not None for c in certified.values())  # all four languages
    rejected = 0
    for stratum, rows in groups.items():
        live = [r for r in rows if not r.base_failed]
        bins = {r.doc_id: [int(np.ceil(r[x] * R.BINS)) for x in R.RULES] for r in live}
        rare = {}
        for j in range(len(R.RULES)):
            ordered = np.sort([b[j] for b in bins.values()])
            for i, b in bins.items():
                share = (len(ordered) - np.searchsorted(ordered, b[j])) / len(ordered)
                rare[i] = min(rare.get(i, 1.0), share)
        def rejects(step, i):
            return np.ceil(rare[i] * R.STEPS / spec.reach) <= step
        mine, step = [i for i in bins if i in good], None
        for t in range(R.STEPS + 1):
            k, n = sum(rejects(t, i) for i in mine), len(mine)
            cdf = sum(float(comb(n, j)) * spec.alpha**j * (1 - spec.alpha) ** (n - j) for j in range(k + 1))
            if cdf > spec.delta / len(groups):
                break
            step = t
        assert certified[stratum] == R.STEPS - step
        false = sum(rejects(step, i) for i in mine)
        assert false <= spec.alpha * len(mine)
        for r in rows:
            assert got[r.doc_id] == (not r.base_failed and not rejects(step, r.doc_id))
            rejected += not r.base_failed and not got[r.doc_id]
    assert rejected > 20
