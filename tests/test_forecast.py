"""Split windows, window models and their comparison."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_signal.operators import domains as dm
from retail_signal.operators import evaluate as ev
from retail_signal.operators import forecast as fc
from retail_signal.operators import series as se

KEY = ["store", "itemno"]


@pytest.fixture(scope="module")
def dense(spark):
    rnd = random.Random(3)
    rows = []
    for s in range(4):
        n = [150, 90, 61, 20][s]
        for d in range(n):
            zero = s == 1 and d > 40
            rows.append((s, f"i{s % 2}", dt.date(2021, 1, 1) + dt.timedelta(days=d),
                         0.0 if zero else float(rnd.randint(0, 9) + d % 7), 6.0, float(750 + s)))
    return spark.createDataFrame(rows, "store int, itemno string, date date, sale_bottles double, pack double, bottle_volume_ml double").repartition(5)


def _rows(df):
    return sorted(map(str, df.select(*KEY, "i", "window_start", "sample_index", "split", "x", "y").collect()))


@pytest.mark.parametrize("options", [{}, {"include_last": True}, {"require_positive": False}, {"fraction": 0.3}])
def test_split_windows_equal_windows_then_split(dense, options):
    fraction = options.get("fraction", 0.8)
    plain = se.supervised_windows(dense, **{k: v for k, v in options.items() if k != "fraction"})
    want = se.chronological_split(plain, fraction=fraction)
    assert _rows(se.split_windows(dense, **options)) == _rows(want)
    for part in ("train", "validation"):
        assert _rows(se.split_windows(dense, part=part, **options)) == _rows(want.where(F.col("split") == part))


def test_split_windows_of_an_empty_table(dense):
    assert se.split_windows(dense.limit(0)).collect() == []


def _arrays(windows):
    rows = windows.collect()
    h = np.array([[d["sale_bottles"] for d in r["x"]] for r in rows])
    return rows, h, np.array([r["y"] for r in rows])


def _regressors(h):
    return np.column_stack([np.ones(len(h))] + [h[:, -k] for k in fc.LAGS] + [h[:, -m:].mean(axis=1) for m in fc.MEANS])


def test_direct_regressor_equals_least_squares(dense):
    train, val = se.split_windows(dense, part="train"), se.split_windows(dense, part="validation")
    _, h, y = _arrays(train)
    beta = fc.fit_direct(train, ridge=0.0)
    want = np.linalg.lstsq(_regressors(h), y, rcond=None)[0]
    assert beta.shape == (8, 30)
    rows, hv, yv = _arrays(val)
    np.testing.assert_allclose(_regressors(hv) @ beta, _regressors(hv) @ want, rtol=1e-6, atol=1e-6)
    got = {(r["store"], r["itemno"], r["i"], r["step"]): (r["y"], r["y_hat"]) for r in fc.direct_predictions(val, beta, key=KEY).collect()}
    assert len(got) == 30 * len(rows)
    for k, r in enumerate(rows):
        for s in (0, 13, 29):
            assert got[(r["store"], r["itemno"], r["i"], s)] == pytest.approx((yv[k, s], (_regressors(hv[k:k + 1]) @ want)[0, s]), abs=1e-6)


def test_sums_do_not_depend_on_partitions(dense):
    train = se.split_windows(dense, part="train")
    a, b = (sorted(map(tuple, fc.normal_equations(t).collect())) for t in (train, train.repartition(9)))
    assert [x[:2] for x in a] == [x[:2] for x in b] == [(i, j) for i in range(8) for j in range(38)]
    np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-9)
    with pytest.raises(ValueError):
        fc.solve(fc.normal_equations(train.limit(0)))


def test_any_function_of_the_user_is_scored_on_the_same_windows(dense):
    val = se.split_windows(dense, part="validation")
    shapes, scale = 3, 2.0

    def model(x):  # closes over values of the caller
        assert x.shape[1:] == (30, shapes)
        return x[:, :, 0] * scale + x[:, :, 1]
    pred = fc.score_windows(val, model, "mine", key=KEY)
    rows, h, _ = _arrays(val)
    got = {(r["store"], r["i"], r["step"]): r["y_hat"] for r in pred.collect()}
    for k, r in enumerate(rows):
        assert got[(r["store"], r["i"], 4)] == 2 * h[k, 4] + 6.0
    both = pred.unionByName(ev.baseline_predictions(val, key=KEY))
    counts = {r["model"]: r["n"] for r in ev.forecast_metrics(both).collect()}
    assert set(counts) == {"mine", "seasonal_naive", "moving_average"} and len(set(counts.values())) == 1
    assert fc.score_windows(val.limit(0), model, key=KEY).collect() == []
    with pytest.raises(Exception, match="the model gave"):
        fc.score_windows(val, lambda x: x[:1, :, 0], key=KEY).collect()


def test_weekday_mean():
    x = np.arange(60.0).reshape(2, 30, 1)
    out = fc.weekday_mean(x)
    assert out.shape == (2, 30)
    assert out[0, 0] == np.mean([23, 16, 9, 2]) and out[0, 8] == np.mean([24, 17, 10, 3])


def test_linear_model_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(scale=0.1, size=400)
    rows = [(1, dt.date(2020, 1, 1), float(a), float(b), float(c), "train" if k < 300 else "validation") for k, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "store int, date date, a double, b double, label double, split string")
    got = ev.regression_predictions(df, ["a", "b"], "label").collect()
    beta = np.linalg.lstsq(np.column_stack([np.ones(300), x[:300]]), y[:300], rcond=None)[0]
    want = np.column_stack([np.ones(100), x[300:]]) @ beta
    np.testing.assert_allclose(sorted(r["y_hat"] for r in got), sorted(want), rtol=1e-6)


def test_samples_are_the_same_on_any_partitions(dense):
    w = se.supervised_windows(dense)
    a, b = (sorted((r["store"], r["i"]) for r in ev.sample_examples(x, 7).collect()) for x in (w, w.repartition(11)))
    assert a == b and len(a) == 7
    c = sorted((r["store"], r["i"]) for r in ev.sample_examples(w, 7, seed=1).collect())
    assert c != a


def test_a_distance_is_the_same_on_any_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=k % 30), float(v + (k % 2) * 4), "target" if k % 2 else "source")
            for k, v in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "store int, date date, f double, domain string")
    a, b = (dm.a_distance(d, ["f"], keys=["store", "date"]).first() for d in (df, df.repartition(7)))
    assert a["err"] == b["err"] < 0.1 and a["a_distance"] > 1.6
    same = df.withColumn("f", F.rand(3))
    assert abs(dm.a_distance(same, ["f"], keys=["store", "date"]).first()["a_distance"]) < 0.6
