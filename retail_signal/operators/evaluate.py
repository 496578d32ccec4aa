"""Forecast baselines, a learned regressor, scoring and error metrics
(L1–L4, D31, D32, H19, C8, F8).

Predictions are long: (model, <series keys>, i, step, y, y_hat) — one row
per forecast day, so metrics are plain grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMAPE_FLOOR = 1e-8


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def baseline_predictions(windows: DataFrame, key=("store", "itemno"), target: str = "sale_bottles") -> DataFrame:
    """L1: two baselines per window — 'seasonal_naive' repeats the last
    ``len(y)`` observed inputs, 'moving_average' predicts their mean."""
    keys = _keys(key)
    hist = F.transform("x", lambda r: r.getField(target))
    w = windows.select(*keys, "i", "y", hist.alias("_h"))
    w = w.withColumn("_m", F.aggregate("_h", F.lit(0.0), lambda s, v: s + v) / F.size("_h"))
    rows = w.select(*keys, "i", "_h", "_m", F.size("y").alias("_n"), F.posexplode("y").alias("step", "y"))
    # The last len(y) inputs, or all of them over and over if there are fewer.
    n_h, last = F.size("_h"), F.least(F.size("_h"), F.col("_n"))
    naive = rows.select(F.lit("seasonal_naive").alias("model"), *keys, "i", "step", "y",
                        F.element_at("_h", (n_h - last + F.pmod("step", last) + 1).cast("int")).alias("y_hat"))
    mavg = rows.select(F.lit("moving_average").alias("model"), *keys, "i", "step", "y",
                       F.col("_m").alias("y_hat"))
    return naive.unionByName(mavg)


def denormalize(pred: DataFrame, fit: DataFrame, column: str = "sale_bottles") -> DataFrame:
    """H19 inverse on y and y_hat with the fit's min and range."""
    s = fit.select(F.struct(F.col(f"{column}_min").alias("mn"), F.col(f"{column}_range").alias("rg"))).scalar()
    return pred.withColumns({c: F.col(c) * s.getField("rg") + s.getField("mn") for c in ("y", "y_hat")})


def forecast_metrics(pred: DataFrame, group: str = "model") -> DataFrame:
    """Per model MAE, MSE (printed as "RMSE" by the reference), the
    true RMSE, and sMAPE in percent with a 1e-8 floor on the denominator."""
    e = F.col("y") - F.col("y_hat")
    denom = F.greatest((F.abs("y") + F.abs("y_hat")) / 2.0, F.lit(SMAPE_FLOOR))
    return pred.groupBy(group).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / denom) * 100.0).alias("smape"),
        F.count(F.lit(1)).alias("n"))


def regression_predictions(features: DataFrame, feature_cols: list[str], label: str,
                           split_col: str = "split", key=("store",), model: str = "linear",
                           max_iter: int = 50) -> DataFrame:
    """L2: one regressor for all series on lag / rolling features, fitted
    on the 'train' rows, scored on 'validation'.  Missing feature values are
    0-filled for the assembler."""
    from pyspark.ml.feature import VectorAssembler
    keys = _keys(key)
    data = features.fillna(0.0, subset=feature_cols).where(F.col(label).isNotNull())
    vec = VectorAssembler(inputCols=feature_cols, outputCol="_features", handleInvalid="keep")
    data = vec.transform(data)
    if model == "gbt":
        from pyspark.ml.regression import GBTRegressor
        est = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=max_iter, seed=7)
    else:
        from pyspark.ml.regression import LinearRegression
        est = LinearRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=0.0)
    fitted = est.fit(data.where(F.col(split_col) == "train"))
    scored = fitted.transform(data.where(F.col(split_col) == "validation"))
    return scored.select(F.lit(model).alias("model"), *keys, "date",
                         F.col(label).cast("double").alias("y"), F.col("prediction").alias("y_hat"))


def sample_examples(windows: DataFrame, n: int = 10, seed: int = 42, key=("store", "itemno")) -> DataFrame:
    """F8: a reproducible sample of n windows, the first by the md5 of series
    key, start and seed: the same rows whatever the partitions (the limit is
    the sampling feature itself)."""
    keys = _keys(key)
    draw = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("i").cast("string"), F.lit(str(seed))))
    return windows.orderBy(draw, *keys, "i").limit(n)


def first_match(lines: DataFrame, key: str, columns: list[str], order: str = "date") -> DataFrame:
    """First value per key (in ``order``) of each column — a grouped
    ``min_by``, one row per key."""
    return lines.groupBy(key).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c)
        for c in columns])


def example_report(samples: DataFrame, pred: DataFrame, lines: DataFrame,
                   key=("store", "itemno"), seq_len: int = 30, lookup: str = "itemno") -> DataFrame:
    """L4: for sampled windows, the forecast start date (text), the item
    description and an address looked up by ``lookup``, and per model the
    predicted and actual arrays (ordered by step)."""
    keys = _keys(key)
    p = (pred.join(samples.select(*keys, "i", "window_start"), keys + ["i"], "left_semi")
             .groupBy("model", *keys, "i")
             .agg(F.array_sort(F.collect_list(F.struct("step", "y", "y_hat"))).alias("_s")))
    p = p.select("model", *keys, "i", F.transform("_s", lambda r: r.getField("y_hat")).alias("predicted"),
                 F.transform("_s", lambda r: r.getField("y")).alias("actual"))
    info = first_match(lines, lookup, ["im_desc", "address"])
    out = p.join(samples.select(*keys, "i", "window_start"), keys + ["i"])
    out = out.join(info, lookup, "left")
    return out.withColumn("forecast_start",
                          F.date_format(F.date_add("window_start", seq_len), "yyyy-MM-dd"))
