"""Registered series / forecasting queries (I7, I8, I9, E14–E18, E20–E22,
B12, C6, D31, D32, H19, L1–L4, M11).

The supervised-window series are (city, category_name) daily bottle
totals: every line contributes, 150 series at sf0.01.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggs import first_non_null, pd_sum
from ..operators import evaluate as ev
from ..operators import forecast as fc
from ..operators import series as se
from ..operators.profile import decompose
from ..operators.aggregate import valid_lines
from .q_temporal import DAILY_SQL, daily_totals
from ..session import cut_lineage
from .registry import register, sales, with_ctes

SKEY = ["city", "category_name"]


def series_day(spark, sf_dir):
    """(city, category_name, date) roll-up: first pack / volume (by
    invoice line), bottle total."""
    s = valid_lines(sales(spark, sf_dir)).where(F.col("city").isNotNull() & F.col("category_name").isNotNull())
    return s.groupBy(*SKEY, "date").agg(
        first_non_null("pack", "invoice_line_no").alias("pack"),
        first_non_null("bottle_volume_ml", "invoice_line_no").alias("bottle_volume_ml"),
        pd_sum("sale_bottles").alias("sale_bottles"))


SERIES_SQL = """sday AS (
  SELECT city, category_name, date,
    MIN({'i': invoice_line_no, 'v': pack}) FILTER (WHERE pack IS NOT NULL).v AS pack,
    MIN({'i': invoice_line_no, 'v': bottle_volume_ml}) FILTER (WHERE bottle_volume_ml IS NOT NULL).v AS bottle_volume_ml,
    CAST(COALESCE(SUM(sale_bottles), 0) AS BIGINT) AS sale_bottles
  FROM sales WHERE store IS NOT NULL AND date IS NOT NULL AND city IS NOT NULL AND category_name IS NOT NULL
  GROUP BY 1, 2, 3
)"""

DENSE_SQL = """sbounds AS (SELECT city, category_name, MIN(date) AS lo, MAX(date) AS hi FROM sday GROUP BY 1, 2),
sgrid AS (SELECT city, category_name, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM sbounds),
dense AS (
  SELECT g.city, g.category_name, g.date,
    CAST(COALESCE(s.sale_bottles, 0) AS BIGINT) AS sale_bottles,
    LAST(s.pack IGNORE NULLS) OVER (PARTITION BY g.city, g.category_name ORDER BY g.date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pack,
    LAST(s.bottle_volume_ml IGNORE NULLS) OVER (PARTITION BY g.city, g.category_name ORDER BY g.date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bottle_volume_ml
  FROM sgrid g LEFT JOIN sday s USING (city, category_name, date)
)"""

FIT_SQL = """fit AS (SELECT
  CAST(MIN(sale_bottles) AS DOUBLE) AS sb_min, CASE WHEN MAX(sale_bottles) = MIN(sale_bottles) THEN 1.0 ELSE CAST(MAX(sale_bottles) - MIN(sale_bottles) AS DOUBLE) END AS sb_range,
  CAST(MIN(pack) AS DOUBLE) AS pk_min, CASE WHEN MAX(pack) = MIN(pack) THEN 1.0 ELSE CAST(MAX(pack) - MIN(pack) AS DOUBLE) END AS pk_range,
  CAST(MIN(bottle_volume_ml) AS DOUBLE) AS bv_min, CASE WHEN MAX(bottle_volume_ml) = MIN(bottle_volume_ml) THEN 1.0 ELSE CAST(MAX(bottle_volume_ml) - MIN(bottle_volume_ml) AS DOUBLE) END AS bv_range
  FROM dense)"""

WINDOWS_SQL = """scaled AS (
  SELECT d.city, d.category_name, d.date,
    (d.sale_bottles - sb_min) / sb_range AS sb, (d.pack - pk_min) / pk_range AS pk,
    (d.bottle_volume_ml - bv_min) / bv_range AS bv,
    CAST(ROW_NUMBER() OVER (PARTITION BY d.city, d.category_name ORDER BY d.date) - 1 AS INTEGER) AS i,
    COUNT(*) OVER (PARTITION BY d.city, d.category_name) AS n
  FROM dense d CROSS JOIN fit),
win AS (
  SELECT city, category_name, i, date AS window_start, n,
    LIST(sb) OVER (PARTITION BY city, category_name ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS h,
    LIST(pk) OVER (PARTITION BY city, category_name ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS hp,
    LIST(sb) OVER (PARTITION BY city, category_name ORDER BY date ROWS BETWEEN 30 FOLLOWING AND 59 FOLLOWING) AS y
  FROM scaled),
win2 AS (SELECT * FROM win WHERE i < n - 60 AND list_sum(y) > 0),
split AS (SELECT *, ROW_NUMBER() OVER (ORDER BY city, category_name, i) - 1 AS sample_index,
  COUNT(*) OVER () AS total FROM win2)"""


def _scaled(spark, sf_dir):
    # The dense series feeds the min-max fit, the windows and the
    # de-normalisation: materialise it once in the shared checkpoint folder.
    dense = cut_lineage(se.fill_missing_dates(series_day(spark, sf_dir), key=SKEY))
    return dense, se.minmax_scale(dense)


I07_SQL = (with_ctes(DAILY_SQL, """rf AS (
  SELECT store, date, sale_dollars,
    LAG(sale_dollars, 1) OVER w AS sales_lag_1, LAG(sale_dollars, 7) OVER w AS sales_lag_7,
    LAG(sale_dollars, 14) OVER w AS sales_lag_14, LAG(sale_dollars, 30) OVER w AS sales_lag_30,
""" + ",\n".join(
    f"""    CASE WHEN COUNT(sale_dollars) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {fn}(sale_dollars) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS sales_rolling_{nm}_{n}"""
    for n in (7, 14, 30) for fn, nm in (("AVG", "mean"), ("STDDEV_SAMP", "std"), ("MAX", "max"), ("MIN", "min")))
    + """,
    LAST(sale_dollars IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vf,
    sale_dollars - LAG(sale_dollars, 1) OVER w AS sales_diff
  FROM daily WINDOW w AS (PARTITION BY store ORDER BY date))""") + """
SELECT store, date, ROUND(sale_dollars, 9) AS sale_dollars,
  """ + ", ".join(f"ROUND(sales_lag_{k}, 9) AS sales_lag_{k}" for k in (1, 7, 14, 30)) + ",\n  " + ", ".join(
    f"ROUND(sales_rolling_{nm}_{n}, 9) AS sales_rolling_{nm}_{n}" for n in (7, 14, 30) for nm in ("mean", "std", "max", "min"))
    + """,
  ROUND(vf / NULLIF(LAG(vf, 1) OVER (PARTITION BY store ORDER BY date), 0) - 1, 9) AS sales_pct_change,
  ROUND(sales_diff, 9) AS sales_diff,
  """ + ", ".join(f"ROUND(sale_dollars - sales_rolling_mean_{n}, 9) AS sales_momentum_{n}" for n in (7, 14, 30)) + """,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend
FROM rf""")


@register("i07_row_features", sql=I07_SQL)
def i07_row_features(spark, sf_dir):
    """Row lags 1/7/14/30, full-window rolling stats over 7/14/30 rows,
    percent change, difference and momentum per store series."""
    return se.row_features(daily_totals(spark, sf_dir))


@register("i08_gap_fill", sql=with_ctes(SERIES_SQL, DENSE_SQL) + "SELECT * FROM dense")
def i08_gap_fill(spark, sf_dir):
    """Dense daily (city, category) series: 0 bottles on new days, pack and
    volume carried forward."""
    return se.fill_missing_dates(series_day(spark, sf_dir), key=SKEY)


@register("d31_minmax_fit", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL) + """SELECT
  ROUND(sb_min, 9) AS sale_bottles_min, ROUND(sb_range, 9) AS sale_bottles_range,
  ROUND(pk_min, 9) AS pack_min, ROUND(pk_range, 9) AS pack_range,
  ROUND(bv_min, 9) AS bottle_volume_ml_min, ROUND(bv_range, 9) AS bottle_volume_ml_range FROM fit""")
def d31_minmax_fit(spark, sf_dir):
    """Min and range (0 → 1) of the three window features."""
    return se.minmax_fit(se.fill_missing_dates(series_day(spark, sf_dir), key=SKEY))


@register("e21_supervised_windows", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL) + """SELECT
  city, category_name, i, window_start, CAST(len(h) AS INTEGER) AS x_len, CAST(len(y) AS INTEGER) AS y_len,
  ROUND(list_sum(h), 9) AS x_sale_bottles_sum, ROUND(list_sum(hp), 9) AS x_pack_sum,
  ROUND(list_sum(y), 9) AS y_sum, ROUND(y[1], 9) AS y_first, ROUND(y[30], 9) AS y_last FROM win2""")
def e21_supervised_windows(spark, sf_dir):
    """30-day input / 30-day target windows over scaled dense series,
    positive-target windows only (arrays summarised per window)."""
    _, scaled = _scaled(spark, sf_dir)
    w = se.supervised_windows(scaled, key=SKEY)
    hb = F.transform("x", lambda r: r.getField("sale_bottles"))
    hp = F.transform("x", lambda r: r.getField("pack"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return w.select(*SKEY, "i", "window_start", F.size("x").cast("int").alias("x_len"),
                    F.size("y").cast("int").alias("y_len"), total(hb).alias("x_sale_bottles_sum"),
                    total(hp).alias("x_pack_sum"), total(F.col("y")).alias("y_sum"),
                    F.element_at("y", 1).alias("y_first"), F.element_at("y", 30).alias("y_last"))


@register("e22_chronological_split", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL) + """SELECT
  city, category_name, i, CAST(sample_index AS BIGINT) AS sample_index,
  CASE WHEN sample_index < FLOOR(total * 0.8) THEN 'train' ELSE 'validation' END AS split FROM split""")
def e22_chronological_split(spark, sf_dir):
    """80/20 split by global sample position (series order, then start)."""
    _, scaled = _scaled(spark, sf_dir)
    return se.split_windows(scaled, key=SKEY).select(*SKEY, "i", "sample_index", "split")


def _validation_predictions(spark, sf_dir):
    dense, scaled = _scaled(spark, sf_dir)
    pred = ev.baseline_predictions(se.split_windows(scaled, key=SKEY, part="validation"), key=SKEY)
    return ev.denormalize(pred, se.minmax_fit(dense))


METRICS_SQL = """SELECT model, ROUND(AVG(ABS(y - y_hat)), 9) AS mae, ROUND(AVG((y - y_hat) * (y - y_hat)), 9) AS mse,
  ROUND(SQRT(AVG((y - y_hat) * (y - y_hat))), 9) AS rmse,
  ROUND(AVG(ABS(y - y_hat) / GREATEST((ABS(y) + ABS(y_hat)) / 2.0, 1e-8)) * 100.0, 9) AS smape,
  COUNT(*) AS n FROM pred GROUP BY model"""


@register("l01_baseline_metrics", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL, """val AS (
  SELECT city, category_name, i, h, y, list_avg(h) AS m FROM split WHERE sample_index >= FLOOR(total * 0.8))""",
    """steps AS (SELECT v.*, s.step FROM val v, (SELECT range AS step FROM range(30)) s)""",
    """pred AS (
  SELECT 'seasonal_naive' AS model, y[step + 1] * sb_range + sb_min AS y, h[step + 1] * sb_range + sb_min AS y_hat FROM steps CROSS JOIN fit
  UNION ALL
  SELECT 'moving_average' AS model, y[step + 1] * sb_range + sb_min AS y, m * sb_range + sb_min AS y_hat FROM steps CROSS JOIN fit)""")
    + METRICS_SQL)
def l01_baseline_metrics(spark, sf_dir):
    """Seasonal-naive and moving-average forecasts on the validation
    windows, de-normalised; MAE, MSE, RMSE, sMAPE per model."""
    return ev.forecast_metrics(_validation_predictions(spark, sf_dir))


@register("l02_regression_forecast")
def l02_regression_forecast(spark, sf_dir):
    """Linear regression on lag / rolling features for all stores at once,
    trained on the first 80 % of days, scored on the rest; metrics."""
    from ..operators.temporal import temporal_features
    feats = temporal_features(daily_totals(spark, sf_dir))
    cols = ["sale_dollars_lag_1d", "sale_dollars_lag_7d", "sale_dollars_lag_14d",
            "sale_dollars_rolling_mean_7D", "sale_dollars_rolling_mean_30D",
            "sale_dollars_rolling_std_30D", "sale_dollars_rolling_median_30D"]
    # Target: next day's value from the row window; features from today.
    from pyspark.sql import Window
    w = Window.partitionBy("store").orderBy("date")
    data = feats.withColumn("label", F.lead("sale_dollars", 1).over(w))
    cut = data.select(F.percentile(F.unix_date("date"), F.lit(0.8))).scalar()
    data = data.withColumn("split", F.when(F.unix_date("date") <= cut, "train").otherwise("validation"))
    pred = ev.regression_predictions(data, cols, "label", key=("store",))
    return ev.forecast_metrics(pred)


@register("l03_normal_equations", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL, """reg AS (
  SELECT [1.0, h[30], h[29], h[24], h[17], list_sum(h[24:30]) / 7.0, list_sum(h[17:30]) / 14.0, list_sum(h) / 30.0] AS r, y
  FROM split WHERE sample_index < FLOOR(total * 0.8))""",
    """cells AS (SELECT i, j, r[i + 1] * CASE WHEN j < 8 THEN r[j + 1] ELSE y[j - 7] END AS v
  FROM reg, (SELECT CAST(range AS INTEGER) AS i FROM range(8)), (SELECT CAST(range AS INTEGER) AS j FROM range(38)))""")
    + "SELECT i, j, ROUND(SUM(v), 6) AS value FROM cells GROUP BY i, j")
def l03_normal_equations(spark, sf_dir):
    """The sums a direct 30-day regressor is solved from, over all training
    windows: regressors by regressors and by forecast days."""
    _, scaled = _scaled(spark, sf_dir)
    sums = fc.normal_equations(se.split_windows(scaled, key=SKEY, part="train"))
    return sums.select("i", "j", F.round("value", 6).alias("value"))


@register("k05_user_model_metrics", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL,
    """steps AS (SELECT v.*, s.step FROM split v, (SELECT range AS step FROM range(30)) s WHERE sample_index >= FLOOR(total * 0.8))""",
    """pred AS (SELECT 'weekday_mean' AS model, y[step + 1] * sb_range + sb_min AS y,
  (h[24 + step % 7] + h[17 + step % 7] + h[10 + step % 7] + h[3 + step % 7]) / 4.0 * sb_range + sb_min AS y_hat
  FROM steps CROSS JOIN fit)""") + METRICS_SQL)
def k05_user_model_metrics(spark, sf_dir):
    """A user's function over arrays of windows (here: same-weekday means)
    scored on the validation windows; its error metrics."""
    dense, scaled = _scaled(spark, sf_dir)
    val = se.split_windows(scaled, key=SKEY, part="validation")
    pred = fc.score_windows(val, fc.weekday_mean, "weekday_mean", key=SKEY)
    return ev.forecast_metrics(ev.denormalize(pred, se.minmax_fit(dense)))


@register("l03_model_comparison")
def l03_model_comparison(spark, sf_dir):
    """Two baselines, the direct regressor fitted on the training windows and
    a user's function, compared on the same validation windows."""
    dense, scaled = _scaled(spark, sf_dir)
    beta = fc.fit_direct(se.split_windows(scaled, key=SKEY, part="train"))
    val = se.split_windows(scaled, key=SKEY, part="validation")
    pred = (ev.baseline_predictions(val, key=SKEY).unionByName(fc.direct_predictions(val, beta, key=SKEY))
            .unionByName(fc.score_windows(val, fc.weekday_mean, "weekday_mean", key=SKEY)))
    return ev.forecast_metrics(ev.denormalize(pred, se.minmax_fit(dense)))


SAMPLE_SQL = """sample AS (SELECT * FROM split WHERE sample_index >= FLOOR(total * 0.8)
  ORDER BY md5(concat_ws('|', city, category_name, CAST(i AS VARCHAR), '42')), city, category_name, i LIMIT 10)"""


def _validation_sample(spark, sf_dir):
    dense, scaled = _scaled(spark, sf_dir)
    val = se.split_windows(scaled, key=SKEY, part="validation")
    return dense, cut_lineage(ev.sample_examples(val, 10, key=SKEY))


@register("f08_window_sample", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL, SAMPLE_SQL)
          + "SELECT city, category_name, i, window_start, CAST(sample_index AS BIGINT) AS sample_index FROM sample")
def f08_window_sample(spark, sf_dir):
    """Ten validation windows drawn by the md5 of their key."""
    _, samples = _validation_sample(spark, sf_dir)
    return samples.select(*SKEY, "i", "window_start", "sample_index")


@register("l04_forecast_examples")
def l04_forecast_examples(spark, sf_dir):
    """Ten sampled validation windows with start date, item text, address
    and predicted / actual arrays per baseline model; only the sampled
    windows are predicted."""
    dense, samples = _validation_sample(spark, sf_dir)
    pred = ev.denormalize(ev.baseline_predictions(samples, key=SKEY), se.minmax_fit(dense))
    # Item text looked up by the series' category (first line by date).
    return ev.example_report(samples, pred, sales(spark, sf_dir), key=SKEY, lookup="category_name")


@register("l04_example_totals", sql=with_ctes(SERIES_SQL, DENSE_SQL, FIT_SQL, WINDOWS_SQL, SAMPLE_SQL,
    """steps AS (SELECT v.*, list_avg(h) AS m, s.step FROM sample v, (SELECT range AS step FROM range(30)) s)""",
    """pred AS (
  SELECT 'seasonal_naive' AS model, *, h[step + 1] * sb_range + sb_min AS y_hat, y[step + 1] * sb_range + sb_min AS yy FROM steps CROSS JOIN fit
  UNION ALL SELECT 'moving_average', *, m * sb_range + sb_min, y[step + 1] * sb_range + sb_min FROM steps CROSS JOIN fit)""",
    """info AS (SELECT category_name, MIN({'d': date, 'v': im_desc}) FILTER (WHERE im_desc IS NOT NULL).v AS im_desc,
  MIN({'d': date, 'v': address}) FILTER (WHERE address IS NOT NULL).v AS address FROM sales GROUP BY category_name)""")
    + """SELECT model, city, category_name, i, strftime(window_start + INTERVAL 30 DAY, '%Y-%m-%d') AS forecast_start,
  im_desc, address, ROUND(SUM(y_hat), 6) AS predicted_total, ROUND(SUM(yy), 6) AS actual_total
FROM pred LEFT JOIN info USING (category_name) GROUP BY ALL""")
def l04_example_totals(spark, sf_dir):
    """The example report with its arrays added up."""
    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6)
    return l04_forecast_examples(spark, sf_dir).select(
        "model", *SKEY, "i", "forecast_start", "im_desc", "address",
        total("predicted").alias("predicted_total"), total("actual").alias("actual_total"))


@register("m11_decomposition", sql=with_ctes(DAILY_SQL, """dd AS (
  SELECT store, date, sale_dollars, weekday(date) AS pos, AVG(sale_dollars) OVER (
    PARTITION BY store ORDER BY date RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 3 DAYS FOLLOWING) AS trend
  FROM daily)""", """pm AS (SELECT store, pos, AVG(sale_dollars - trend) AS pmv FROM dd GROUP BY 1, 2)""",
    """ps AS (SELECT store, pos, pmv - AVG(pmv) OVER (PARTITION BY store) AS seasonal FROM pm)""")
    + """SELECT dd.store, dd.date, ROUND(dd.sale_dollars, 9) AS sale_dollars, ROUND(dd.trend, 9) AS trend,
  ROUND(ps.seasonal, 9) AS seasonal, ROUND(dd.sale_dollars - dd.trend - ps.seasonal, 9) AS resid
FROM dd JOIN ps ON ps.store = dd.store AND ps.pos = dd.pos""")
def m11_decomposition(spark, sf_dir):
    """Additive trend / weekly seasonal / residual split of each store's
    daily series (means over seven calendar days, weekday seasons)."""
    return decompose(daily_totals(spark, sf_dir), "store", "date", "sale_dollars", 7)


# Per-ID slices of I7 (row-based windows per store series).
ROW_SLICES = {
    "e14_row_lags": [f"sales_lag_{k}" for k in (1, 7, 14, 30)],
    "e15_row_rolling": [f"sales_rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std", "max", "min")],
    "e16_pct_change": ["sales_pct_change"],
    "e17_first_difference": ["sales_diff"],
    "e18_row_momentum": [f"sales_momentum_{n}" for n in (7, 14, 30)],
}


def _register_row_slice(name: str, cols: list[str]):
    def build(spark, sf_dir):
        return i07_row_features(spark, sf_dir).select("store", "date", "sale_dollars", *cols)
    build.__doc__ = f"I7 slice: {', '.join(cols)}."
    head, _, final = I07_SQL.rpartition("\nSELECT store, date, ROUND(sale_dollars, 9) AS sale_dollars,")
    sql = (head + "\nSELECT store, date, sale_dollars, " + ", ".join(cols)
           + " FROM (SELECT store, date, ROUND(sale_dollars, 9) AS sale_dollars," + final + ")")
    register(name, sql=sql)(build)


for _name, _cols in ROW_SLICES.items():
    _register_row_slice(_name, _cols)
