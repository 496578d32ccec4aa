import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_signal.llm import quality as Q
from .helpers import frame, odd_rows, prose

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_held_out_labels_are_not_used(spark):
    got = Q.op7_quality_pu(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert got.where("held_out").agg(F.avg(F.expr("double(predicted = quality)"))).first()[0] > 0.97
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = Q.crc_fold("doc_id", 3)
    flipped = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, Q.quality_scores(docs, x, fold != 1).collect())) for x in (labels, flipped))
    assert np.allclose(a, b)


def test_risk_of_negatives_stays_at_zero_or_above(spark):
    """Few positives that all look alike: an unbounded risk would run away."""
    rows = [(i, prose(40, i)) for i in range(30)]
    positives = spark.createDataFrame([(i,) for i in range(3)], "p_id long")
    codes = Q.patterns(frame(spark, rows))
    weights = Q.fit(codes, positives, 0.99, Q.PuSpec(ridge=1e-6, passes=15))
    at = Q._slots(np.array([r.pattern for r in codes.collect()]))
    z = weights[at].sum(1)
    p = weights[Q._slots(np.array([r.pattern for r in codes.where("doc_id < 3").collect()]))].sum(1)
    assert np.logaddexp(0, z).mean() - 0.99 * np.logaddexp(0, p).mean() >= -1e-9


def _dense(codes, positive, prior, ridge):
    """The least of max(R, pi E_P[l(z)]) by bisection on the multiplier of
    plain Newton minima, on one machine."""
    x = np.zeros((len(codes), Q.SIZE))
    x[np.arange(len(codes))[:, None], Q._slots(codes)] = 1
    xp = x[positive]

    def value(w):
        zu, zp = x @ w, xp @ w
        own = prior * np.logaddexp(0, -zp).mean()
        return np.logaddexp(0, zu).mean() - prior * zp.mean(), own, zu, zp

    def newton(theta):
        w = np.zeros(Q.SIZE)
        for _ in range(200):
            _, _, zu, zp = value(w)
            su, sp = 1 / (1 + np.exp(-zu)), 1 / (1 + np.exp(zp))
            g = theta * (x.T @ su / len(x) - prior * xp.mean(0)) - (1 - theta) * prior * xp.T @ sp / len(xp) + ridge * w
            h = theta * (x.T * (su * (1 - su))) @ x / len(x) + (1 - theta) * prior * (xp.T * (sp * (1 - sp))) @ xp / len(xp) + ridge * np.eye(Q.SIZE)
            d, step = np.linalg.solve(h, g), 1.0

            def total(v):
                return theta * value(v)[0] + (1 - theta) * value(v)[1] + ridge / 2 * v @ v
            while total(w - step * d) > total(w) - 1e-4 * step * g @ d and step > 1e-9:
                step /= 2
            w = w - step * d
            if np.abs(g).max() < 1e-9:
                break
        return w
    low, high = 0.0, 1.0
    w = newton(1.0)
    if np.subtract(*value(w)[:2]) < 0:
        for _ in range(45):
            middle = (low + high) / 2
            w = newton(middle)
            low, high = (middle, high) if np.subtract(*value(w)[:2]) > 0 else (low, middle)
    return max(value(w)[:2]) + ridge / 2 * w @ w, x, xp


def test_fit_reaches_the_minimum_of_a_dense_solver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").collect()}
    codes = Q.patterns(docs)
    rows = codes.collect()
    pattern, positive = np.array([r.pattern for r in rows]), np.array([r.doc_id in labels for r in rows])
    assert len(rows) >= 200 and positive.sum() > 20
    ids = spark.createDataFrame([(i,) for i in labels], "p_id long")
    edges = set()
    for prior in (0.5, 0.8, 0.9):
        report = {}
        spec = Q.PuSpec(ridge=1e-2, tolerance=1e-8)
        w = Q.fit(codes, ids, prior, spec, report)
        least, x, xp = _dense(pattern, positive, prior, spec.ridge)
        zu, zp = x @ w, xp @ w
        own, n = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        assert report["converged"] and report["passes"] < 60 and n >= -1e-7
        assert abs(own + max(0, n) + spec.ridge / 2 * w @ w - least) < 1e-6
        edges.add(report["theta"] < 1)
    assert edges == {True, False}  # both kinds of minimum were met


def test_a_fit_that_is_cut_short_says_so(spark):
    codes = Q.patterns(frame(spark, [(i, prose(40, i)) for i in range(30)]))
    ids = spark.createDataFrame([(i,) for i in range(3)], "p_id long")
    with pytest.warns(RuntimeWarning, match="not minimised"):
        Q.fit(codes, ids, 0.7, Q.PuSpec(passes=2))


def test_distributed_pass_equals_the_definition(spark):
    codes = Q.patterns(frame(spark, odd_rows()[3:])).withColumns({"n_u": F.lit(2).cast("long"), "n_p": F.lit(1).cast("long")})
    w = np.linspace(-1, 1, Q.SIZE)
    sums = Q._summed(codes.select("pattern", "n_u", "n_p"), Q._pass(w))
    z = w[Q._slots(np.array([r.pattern for r in codes.collect()]))].sum(1)
    assert np.allclose(sums[:2], [2 * np.logaddexp(0, z).sum(), np.logaddexp(0, z).sum()])


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (99, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, odd_rows())
    got = Q.quality_scores(docs, labels, F.lit(True)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert Q.quality_scores(frame(spark, []), labels, F.lit(True)).count() == 0
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    kept = Q.accepted(docs, labels, F.lit(True), cutoff=0.0)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows())
    assert Q.accepted(docs, labels, F.lit(True), cutoff=1.1).count() == 0
    assert Q.accepted(frame(spark, []), labels, F.lit(True)).count() == 0
