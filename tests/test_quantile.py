"""Distributed exact quantiles against NumPy's linear interpolation."""

import numpy as np
import pytest

from retail_signal.operators.quantile import _Target, double_at, exact_quantiles, place_of

PROBS = [0.0, 0.01, 0.25, 0.33, 0.5, 0.66, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["continuous", "ties", "hot_value", "tiny"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "continuous":
        x = rng.normal(100, 30, 20000)
    elif kind == "ties":
        x = rng.integers(0, 50, 20000).astype(float)
    elif kind == "hot_value":  # a third of the rows on one value
        x = np.concatenate([rng.exponential(10, 14000), np.full(7000, 3.25)])
    else:
        x = np.array([1.0, 2.0, 3.0, 4.0])
    rows = [(float(v), float(v) * 2 if i % 7 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(8)
    got = exact_quantiles(df, {"a": PROBS, "b": [0.5]}, accuracy=100)
    np.testing.assert_allclose(got["a"], np.quantile(x, PROBS), rtol=1e-12, atol=1e-9)
    b = np.array([r[1] for r in rows if r[1] is not None])
    np.testing.assert_allclose(got["b"], [np.quantile(b, 0.5)], rtol=1e-12)


@pytest.mark.parametrize("x", [[1.0] * 500 + [2.0] * 500, [1e300, -1e300] * 50, list(range(3000)), [0.1] * 999 + [0.1 + 1e-15]])
def test_any_data_ends_without_candidates_on_the_driver(spark, x):
    df = spark.createDataFrame([(float(v),) for v in x], "a double").repartition(4)
    rounds = []
    got = exact_quantiles(df, {"a": [0.0, 0.5, 0.77, 1.0]}, accuracy=3, trace=rounds)["a"]
    assert len(rounds) <= 64
    np.testing.assert_allclose(got, np.quantile(np.array(x, float), [0.0, 0.5, 0.77, 1.0]), rtol=1e-12)


@pytest.mark.parametrize("x", [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf")])
def test_places_follow_the_order_of_doubles(x):
    assert double_at(place_of(x)) == x
    for y in (0.0, 1.0, -2.0, 3e-310, 1e308):
        assert (place_of(x) < place_of(y)) == (x < y)


def test_rounds_stay_bounded_without_help_of_the_brackets():
    """The middle alone finds any rank in 64 counts."""
    rng = np.random.default_rng(3)
    x = np.sort(np.concatenate([rng.normal(0, 1e-300, 200), rng.normal(0, 1e300, 200), [0.0, -0.0, np.inf, -np.inf]]))
    for r in (0, 1, 57, 203, 402, 403):
        t, rounds = _Target("a", r, x[0], x[-1], len(x)), 0
        while t.value is None:
            m, rounds = t.middle(), rounds + 1
            t.learn(m, int((x <= m).sum()), int((x < m).sum()))
        assert t.value == x[r] and rounds <= 64


def test_usual_data_takes_few_rounds(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2, 50, 30_000)], "a double").repartition(4)
    rounds = []
    exact_quantiles(df, {"a": [0.25, 0.5, 0.9]}, trace=rounds)
    assert len(rounds) <= 4


def test_weighted_quantiles_match_repeated_rows(spark):
    from retail_signal.operators.quantile import weighted_quantiles
    rng = np.random.default_rng(5)
    v, w = rng.integers(0, 40, 300).astype(float), rng.integers(0, 9, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w)] + [(None, 3)], "v double, w long").repartition(6)
    np.testing.assert_allclose(weighted_quantiles(df, "v", "w", PROBS), np.quantile(np.repeat(v, w), PROBS), rtol=1e-12)
    assert weighted_quantiles(df.limit(0), "v", "w", [0.5]) == [None]


def test_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert exact_quantiles(df, {"a": [0.5]}) == {"a": [None]}


def test_grouped_quantiles_match_numpy(spark):
    from retail_signal.operators.quantile import grouped_quantiles
    rng = np.random.default_rng(11)
    groups = {"hot": np.concatenate([rng.normal(5, 2, 3000), np.full(1500, 4.0)]),
              "b": rng.integers(0, 9, 301).astype(float), "c": np.array([2.5])}
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probs = [0.25, 0.5, 0.75]
    out = {r.g: r for r in grouped_quantiles(df, ["g"], "x", probs, ["q1", "q2", "q3"]).collect()}
    for g, vals in groups.items():
        np.testing.assert_allclose([out[g].q1, out[g].q2, out[g].q3], np.quantile(vals, probs), rtol=1e-12)
        assert out[g].n == len(vals)


def test_grouped_quantile_columns_equal_percentile(spark):
    from pyspark.sql import functions as F
    from retail_signal.operators.quantile import grouped_quantile_columns
    rng = np.random.default_rng(17)
    rows = [(int(g), float(a), None if i % 5 == 0 else float(b))
            for i, (g, a, b) in enumerate(zip(rng.integers(0, 6, 900), rng.normal(100, 40, 900),
                                              rng.integers(0, 12, 900)))]
    rows += [(9, 1.0, None)]  # a group whose second column is all NULL
    df = spark.createDataFrame(rows, "g long, a double, b double").repartition(5)
    got = {r.g: (r.a_med, r.b_med) for r in
           grouped_quantile_columns(df, ["g"], ["a", "b"], 0.5, ["a_med", "b_med"]).collect()}
    ref = {r.g: (r.a_med, r.b_med) for r in df.groupBy("g").agg(
        F.percentile("a", F.lit(0.5)).alias("a_med"), F.percentile("b", F.lit(0.5)).alias("b_med")).collect()}
    assert got == ref
