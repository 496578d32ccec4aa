"""Registered temporal queries."""

from __future__ import annotations

from ..functions.aggs import pd_sum
from ..operators.aggregate import valid_lines
from ..operators.temporal import temporal_features
from .registry import register, sales, with_ctes
from .sqlgen import select_rounded, temporal_columns, temporal_cte

DAILY_SQL = """daily AS (
  SELECT store, date, COALESCE(SUM(sale_dollars), 0) AS sale_dollars
  FROM sales WHERE store IS NOT NULL AND date IS NOT NULL GROUP BY store, date
)"""


def daily_totals(spark, sf_dir):
    return valid_lines(sales(spark, sf_dir)).groupBy("store", "date").agg(
        pd_sum("sale_dollars").alias("sale_dollars"))


TEMPORAL_SQL = with_ctes(DAILY_SQL, temporal_cte("daily"))


def _temporal_sql(cols):
    return TEMPORAL_SQL + select_rounded(
        [("store", False), ("date", False), ("sale_dollars", True)] + cols, "temporal")


@register("i03_temporal_features", sql=_temporal_sql(temporal_columns()))
def i03_temporal_features(spark, sf_dir):
    """Flagship: store-day totals → calendar lags, 7–90-day rolling
    statistics, momentum and decline flags per store."""
    return temporal_features(daily_totals(spark, sf_dir))


# Per-ID slices of I3.  Each selects its columns from the same plan; column
# pruning drops the window expressions a slice does not use, so a slice
# costs only its own frames (one exchange on ``store`` and one sort).
_T = "sale_dollars"
_W = ("7D", "14D", "30D", "60D", "90D")
TEMPORAL_SLICES = {
    "e01_calendar_lags": [f"{_T}_lag_{k}d" for k in (1, 7, 14, 30, 60)],
    "e02_rolling_mean": [f"{_T}_rolling_mean_{w}" for w in _W],
    "e03_rolling_std": [f"{_T}_rolling_std_{w}" for w in _W],
    "e04_rolling_max": [f"{_T}_rolling_max_{w}" for w in _W],
    "e05_rolling_min": [f"{_T}_rolling_min_{w}" for w in _W],
    "e06_rolling_median": [f"{_T}_rolling_median_{w}" for w in _W],
    "e07_momentum": [f"{_T}_momentum_{w}" for w in _W],
    "e08_relative_momentum": [f"{_T}_rel_momentum_{w}" for w in _W],
    "e09_days_since_last_purchase": ["days_since_last_purchase"],
    "d30_mean_purchase_gap": ["avg_days_between_purchases_30D"],
    "e10_decline_prev_day": [f"{_T}_decrease_prev"],
    "e11_decline_vs_mean": [f"{_T}_decrease_7d_avg", f"{_T}_decrease_30d_avg"],
    "e12_significant_decline": [f"{_T}_significant_decrease"],
    "e13_consecutive_decline": ["consecutive_decrease"],
    "h11_cyclic_encodings": ["month_sin", "month_cos", "day_of_month_sin", "day_of_month_cos"],
}


def _register_slice(name: str, cols: list[str]):
    kinds = dict(temporal_columns())

    def build(spark, sf_dir):
        return i03_temporal_features(spark, sf_dir).select("store", "date", _T, *cols)
    build.__doc__ = f"I3 slice: {', '.join(cols)}."
    register(name, sql=_temporal_sql([(c, kinds[c]) for c in cols]))(build)


for _name, _cols in TEMPORAL_SLICES.items():
    _register_slice(_name, _cols)
