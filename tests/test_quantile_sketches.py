"""Targets of one interval share a sketch."""

from retail_signal.operators import quantile as qu


def test_one_sketch_per_column_in_the_first_round(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 5), float(i % 3) if i % 7 else None) for i in range(100)], "a double, b double")
    made, plain = [], qu.F.percentile_approx
    monkeypatch.setattr(qu.F, "percentile_approx", lambda *a: made.append(a) or plain(*a))
    trace = []
    found = qu.exact_quantiles(rows, {"a": [0.25, 0.5, 0.75], "b": [0.25, 0.5, 0.75]}, trace=trace)
    assert found == {"a": [1.0, 2.0, 3.0], "b": [0.0, 1.0, 2.0]}
    assert len(trace) == 1 and len(made) == 2  # ten targets of two columns


def test_many_rounds_stay_exact(spark):
    import numpy as np
    x = np.random.default_rng(3).lognormal(0, 4, 5000)
    rows = spark.createDataFrame([(float(v), None if i % 4 else float(-v)) for i, v in enumerate(x)], "a double, b double")
    probs, trace = [0.01, 0.25, 0.5, 0.9], []
    found = qu.exact_quantiles(rows, {"a": probs, "b": probs}, accuracy=20, trace=trace)
    assert len(trace) > 1
    np.testing.assert_allclose(found["a"], np.quantile(x, probs), rtol=1e-12)
    np.testing.assert_allclose(found["b"], np.quantile(-x[::4], probs), rtol=1e-12)
