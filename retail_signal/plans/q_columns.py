"""Registered column-level queries: store attributes (D1), global
quantiles (D19), group means written back (C3), calendar parts (H1–H6,
H10), geo parsing (H17), and the optional cleaning steps (I11, I12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggs import first_non_null
from ..functions.scalar import date_text, first_of_month, geo_lat, geo_lon, weekday_name
from ..operators.aggregate import STORE_ATTRIBUTES, valid_lines
from ..operators.calendar import date_parts
from ..operators.clean import SALES_COLUMNS, clip_negative_sales, winsorize
from ..operators.store import SIZE_QUANTILES, group_mean
from .q_temporal import DAILY_SQL, daily_totals
from .registry import register, sales, with_ctes

ATTRS_SQL = """attrs AS (
  SELECT store,
    """ + ",\n    ".join(
    f"ARG_MIN({a}, {{'d': date, 'i': invoice_line_no}}) FILTER (WHERE {a} IS NOT NULL) AS {a}"
    for a in STORE_ATTRIBUTES) + """
  FROM sales WHERE store IS NOT NULL AND date IS NOT NULL GROUP BY store
)"""


def store_attributes(spark, sf_dir):
    return (valid_lines(sales(spark, sf_dir)).groupBy("store")
            .agg(*[first_non_null(a, "date", "invoice_line_no").alias(a) for a in STORE_ATTRIBUTES]))


@register("d01_store_attributes", sql=with_ctes(ATTRS_SQL) + "SELECT * FROM attrs")
def d01_store_attributes(spark, sf_dir):
    """First non-NULL name, address, city, zipcode, location and county per
    store in (date, line) order; one partial aggregate per store."""
    return store_attributes(spark, sf_dir)


@register("d19_global_quantiles", sql=with_ctes(DAILY_SQL) + """SELECT
  ROUND(QUANTILE_CONT(sale_dollars, 0.33), 9) AS q33, ROUND(QUANTILE_CONT(sale_dollars, 0.66), 9) AS q66,
  COUNT(*) AS n_rows FROM daily""")
def d19_global_quantiles(spark, sf_dir):
    """0.33 / 0.66 quantiles of store-day sales over rows (linear
    interpolation), exact and distributed (``exact_quantiles``)."""
    from ..operators.quantile import exact_quantiles
    from ..session import cut_lineage
    daily = cut_lineage(daily_totals(spark, sf_dir))  # read by several passes
    q = exact_quantiles(daily, {"sale_dollars": list(SIZE_QUANTILES)})["sale_dollars"]
    return daily.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(q[0]).cast("double").alias("q33"), F.lit(q[1]).cast("double").alias("q66"), "n_rows")


@register("c03_group_means", sql=with_ctes(DAILY_SQL, ATTRS_SQL) + """SELECT d.store, d.date,
  a.city, a.county, ROUND(d.sale_dollars, 9) AS sale_dollars,
  ROUND(AVG(d.sale_dollars) OVER (PARTITION BY d.store), 9) AS store_avg_sales,
  CASE WHEN a.city IS NOT NULL THEN ROUND(AVG(d.sale_dollars) OVER (PARTITION BY a.city), 9) END AS city_avg_sales,
  CASE WHEN a.county IS NOT NULL THEN ROUND(AVG(d.sale_dollars) OVER (PARTITION BY a.county), 9) END AS county_avg_sales
FROM daily d JOIN attrs a USING (store)""")
def c03_group_means(spark, sf_dir):
    """Store, city and county mean of store-day sales written back to
    every store-day: per-key aggregates joined on the key (AQE broadcasts
    the per-key tables when they are measured small)."""
    attrs = store_attributes(spark, sf_dir).select("store", "city", "county")
    df = daily_totals(spark, sf_dir).join(attrs, "store")
    df = group_mean(df, "store", "sale_dollars", "store_avg_sales")
    df = group_mean(df, "city", "sale_dollars", "city_avg_sales")
    df = group_mean(df, "county", "sale_dollars", "county_avg_sales")
    return df.select("store", "date", "city", "county", "sale_dollars",
                     "store_avg_sales", "city_avg_sales", "county_avg_sales")


@register("h01_date_parts", sql=with_ctes("""dd AS (SELECT DISTINCT date FROM sales WHERE date IS NOT NULL)""")
          + """SELECT date,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(dayofmonth(date) AS INTEGER) AS day_of_month,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year, dayname(date) AS weekday_name,
  strftime(date, '%Y-%m-%d') AS date_text, make_date(year(date), month(date), 1) AS first_of_month
FROM dd""")
def h01_date_parts(spark, sf_dir):
    """Calendar parts of every distinct sales date (Monday = 0, ISO week,
    weekend flag, weekday name, text, first of month)."""
    dd = sales(spark, sf_dir).where(F.col("date").isNotNull()).select("date").distinct()
    return date_parts(dd).withColumns({
        "weekday_name": weekday_name("date"), "date_text": date_text("date"),
        "first_of_month": first_of_month(F.year("date"), F.month("date"))})


@register("h17_geo_points", sql=with_ctes("""loc AS (SELECT DISTINCT store_location FROM sales)""")
          + """SELECT store_location,
  ROUND(CAST(REPLACE(store_location, '''', '"')::JSON->'coordinates'->>0 AS DOUBLE), 9) AS lon,
  ROUND(CAST(REPLACE(store_location, '''', '"')::JSON->'coordinates'->>1 AS DOUBLE), 9) AS lat
FROM loc""")
def h17_geo_points(spark, sf_dir):
    """Point text → (lon, lat) for every distinct location text."""
    loc = sales(spark, sf_dir).select("store_location").distinct()
    return loc.select("store_location", geo_lon("store_location").alias("lon"),
                      geo_lat("store_location").alias("lat"))


@register("i11_clip_negative", sql=with_ctes() + "SELECT invoice_line_no, store, date, "
          + ", ".join(f"ROUND(CAST(GREATEST({c}, 0) AS DOUBLE), 9) AS {c}" if c != "sale_bottles"
                      else "GREATEST(sale_bottles, 0) AS sale_bottles" for c in SALES_COLUMNS)
          + " FROM sales")
def i11_clip_negative(spark, sf_dir):
    """Optional cleaning: negative bottles / dollars / liters / gallons → 0
    on every line (narrow, no shuffle)."""
    return clip_negative_sales(sales(spark, sf_dir)).select(
        "invoice_line_no", "store", "date", *SALES_COLUMNS)


WINSOR_COLUMNS = ["sale_bottles", "sale_dollars", "sale_liters", "sale_gallons",
                  "state_bottle_cost", "state_bottle_retail", "pack", "bottle_volume_ml"]


def _winsor_sql() -> str:
    qs = ",\n  ".join(f"QUANTILE_CONT({c}, 0.01) AS {c}_lo, QUANTILE_CONT({c}, 0.99) AS {c}_hi"
                      for c in WINSOR_COLUMNS)
    sel = []
    for c in WINSOR_COLUMNS:
        lo = f"(q.{c}_lo - 1.5 * (q.{c}_hi - q.{c}_lo))"
        hi = f"(q.{c}_hi + 1.5 * (q.{c}_hi - q.{c}_lo))"
        sel.append(f"ROUND(CAST(CASE WHEN s.{c} < {lo} THEN {lo} WHEN s.{c} > {hi} THEN {hi} "
                   f"ELSE s.{c} END AS DOUBLE), 9) AS {c}")
    return (with_ctes(f"q AS (SELECT\n  {qs}\nFROM sales)")
            + "SELECT s.invoice_line_no, " + ",\n  ".join(sel) + "\nFROM sales s CROSS JOIN q")


@register("i12_winsorize", sql=_winsor_sql())
def i12_winsorize(spark, sf_dir):
    """Optional cleaning: clip numeric line columns to
    [q01 − 1.5·(q99 − q01), q99 + 1.5·(q99 − q01)]; the 16 quantiles are
    found together by ``exact_quantiles`` (a few one-row aggregate passes)."""
    df = sales(spark, sf_dir).select("invoice_line_no", *WINSOR_COLUMNS)
    out = winsorize(df, WINSOR_COLUMNS)
    return out.select("invoice_line_no", *[F.col(c).cast("double").alias(c) for c in WINSOR_COLUMNS])


@register("c08_item_lookup", sql=with_ctes() + """SELECT itemno,
  ARG_MIN(im_desc, {'d': date, 'i': invoice_line_no}) FILTER (WHERE im_desc IS NOT NULL) AS im_desc,
  ARG_MIN(category_name, {'d': date, 'i': invoice_line_no}) FILTER (WHERE category_name IS NOT NULL) AS category_name
FROM sales WHERE itemno IS NOT NULL GROUP BY itemno""")
def c08_item_lookup(spark, sf_dir):
    """First-match description and category per item (earliest line), the
    lookup table the forecast examples join back by item."""
    lines = sales(spark, sf_dir).where(F.col("itemno").isNotNull())
    return lines.groupBy("itemno").agg(
        first_non_null("im_desc", "date", "invoice_line_no").alias("im_desc"),
        first_non_null("category_name", "date", "invoice_line_no").alias("category_name"))


@register("f06_head_preview", sql=with_ctes(DAILY_SQL)
          + "SELECT store, date, ROUND(sale_dollars, 9) AS sale_dollars FROM daily ORDER BY store, date LIMIT 5")
def f06_head_preview(spark, sf_dir):
    """First five store-day rows in (store, date) order (a top-k:
    each task keeps five rows)."""
    return daily_totals(spark, sf_dir).orderBy("store", "date").limit(5)
