"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from .registry import register, sales, with_ctes
from .sqlgen import (select_rounded, store_day_agg_cte, store_day_agg_items,
                     store_day_columns, store_day_cte)


@register("d12_store_day_aggregates", sql=with_ctes(store_day_agg_cte("sd_aggs")) + select_rounded(
    [("store", False), ("date", False)] + [(a, d) for _, a, d in store_day_agg_items()], "sd_aggs"))
def d12_store_day_aggregates(spark, sf_dir):
    """The 60 pandas-style aggregates per (store, date)."""
    return agg.store_day_aggregates(sales(spark, sf_dir))


@register("i01_store_day", sql=with_ctes(store_day_cte()) + select_rounded(store_day_columns(), "store_day"))
def i01_store_day(spark, sf_dir):
    """Store-day table: attributes, item records (as their count), 60
    aggregates, coordinates and median-filled ratios."""
    sd = agg.store_day(agg.prepared_lines(sales(spark, sf_dir)), materialize=True)
    return (sd.withColumn("item_details_count", F.size("item_details").cast("bigint"))
              .drop("item_details"))
