"""Forecast models over supervised windows (L2, L3, K5).

``score_windows`` runs any model of the user over the windows: a function from
an array (samples, days, features) to one (samples, horizon).  It is sent to
each executor once, as a broadcast, and called once per Arrow batch.

``fit_direct`` is a direct multi-step regressor: one linear model per forecast
day, all from the same sums.  X'X and X'Y are added up inside each task, one
matrix a task leaves it, and what reaches the driver is their sum, whose size
is the square of the number of regressors and never depends on the rows.

Predictions are long like those of the baselines: (model, keys, i, step, y,
y_hat), so ``evaluate.forecast_metrics`` compares models on the same windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Regressors of a window: the target so many days before its end, and its
#: mean over so many last days.
LAGS = (1, 2, 7, 14)
MEANS = (7, 14, 30)


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def window_regressors(target: str = "sale_bottles", lags=LAGS, means=MEANS) -> Column:
    """The regressors of a window as one array, the first one constant."""
    h = F.transform("x", lambda r: r.getField(target))
    parts = [F.lit(1.0)] + [F.element_at(h, -k) for k in lags]
    parts += [F.aggregate(F.slice(h, -m, m), F.lit(0.0), lambda s, v: s + v) / F.lit(float(m)) for m in means]
    return F.array(*parts)


def _matrix(values: pa.ListArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def normal_equations(windows: DataFrame, regressors: Column | None = None) -> DataFrame:
    """(i, j, value): the sum over all windows of regressor i times regressor
    j, and from j = number of regressors on, times the days of ``y``."""
    rows = windows.select((window_regressors() if regressors is None else regressors).alias("r"), "y")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                r = _matrix(batch.column(0))
                part = r.T @ np.hstack([r, _matrix(batch.column(1))])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                                             names=["i", "j", "value"])
    return rows.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def solve(sums: DataFrame, ridge: float = 1e-9) -> np.ndarray:
    """Coefficients (regressors, horizon) from ``normal_equations``."""
    cells = sums.collect()
    if not cells:
        raise ValueError("no window to fit on")
    p = 1 + max(c["i"] for c in cells)
    m = np.zeros((p, 1 + max(c["j"] for c in cells)))
    for c in cells:
        m[c["i"], c["j"]] = c["value"]
    xx, xy = m[:, :p], m[:, p:]
    return np.linalg.lstsq(xx + ridge * np.trace(xx) / p * np.eye(p), xy, rcond=None)[0]


def fit_direct(train: DataFrame, regressors: Column | None = None, ridge: float = 1e-9) -> np.ndarray:
    return solve(normal_equations(train, regressors), ridge)


_MODELS: dict[int, Callable] = {}


def _applied(windows: DataFrame, inputs: Column, shape: tuple[int, ...], predict: Callable, name: str, keys: list[str]) -> DataFrame:
    """``predict`` over ``inputs`` (arrays of doubles) of every window."""
    spark = windows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(predict))
    which = id(sent)
    rows = windows.select(*keys, "i", "y", inputs.cast("array<double>").alias("_in"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(which)
        if model is None:
            _MODELS.clear()
            model = _MODELS[which] = cloudpickle.loads(sent.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(n_in).flatten().to_numpy(zero_copy_only=False).reshape(n, *shape)
            y_hat = np.asarray(model(x), np.float64)
            if y_hat.ndim != 2 or len(y_hat) != n:
                raise ValueError(f"the model gave {y_hat.shape} for {n} windows")
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * y_hat.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(y_hat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_in], lists], names=out)
    n_in, out = len(rows.columns) - 1, [*rows.columns[:-1], "_out"]
    schema = rows.drop("_in").withColumn("_out", F.lit(None).cast("array<double>")).schema
    scored = rows.mapInArrow(score, schema).withColumn("_both", F.arrays_zip("y", "_out"))
    long = scored.select(*keys, "i", F.posexplode("_both").alias("step", "_p"))
    return long.select(F.lit(name).alias("model"), *keys, "i", "step", F.col("_p.y").alias("y"), F.col("_p._out").alias("y_hat"))


def score_windows(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], name: str = "user",
                  features=("sale_bottles", "pack", "bottle_volume_ml"), seq_len: int = 30, key=("store", "itemno")) -> DataFrame:
    """K5: ``predict`` maps (samples, seq_len, features) to (samples, horizon)."""
    record = F.flatten(F.transform("x", lambda r: F.array(*[r.getField(c) for c in features])))
    return _applied(windows, record, (seq_len, len(features)), predict, name, _keys(key))


def direct_predictions(windows: DataFrame, coefficients: np.ndarray, name: str = "direct_linear",
                       regressors: Column | None = None, key=("store", "itemno")) -> DataFrame:
    """L2: the direct multi-step regressor over ``windows``."""
    columns = window_regressors() if regressors is None else regressors
    return _applied(windows, columns, (len(coefficients),), lambda r: r @ coefficients, name, _keys(key))


def weekday_mean(x: np.ndarray) -> np.ndarray:
    """An example of a user model: the mean of the first feature on the same
    weekday of the last four weeks, for 30 days."""
    days = np.arange(30) % 7
    return np.mean([x[:, x.shape[1] - 7 * k + days, 0] for k in (1, 2, 3, 4)], axis=0)
