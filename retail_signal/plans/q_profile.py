"""Registered profiling queries (D13–D29, D33, F3–F5, F7, F9, G2, B2,
B11, C7, H13, M10, M11)."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import profile as prof
from ..operators.clean import null_report
from ..session import cut_lineage
from .registry import register, sales, with_ctes

NUMERIC = ["store", "category", "itemno", "pack", "bottle_volume_ml", "state_bottle_cost",
           "state_bottle_retail", "sale_bottles", "sale_dollars", "sale_liters", "sale_gallons"]
CATEGORICAL = ["store_location", "county", "category_name", "im_desc"]
ALL_COLS = ["invoice_line_no", "date", "store", "name", "address", "city", "zipcode",
            "store_location", "county", "category", "category_name", "itemno", "im_desc", "pack",
            "bottle_volume_ml", "state_bottle_cost", "state_bottle_retail", "sale_bottles",
            "sale_dollars", "sale_liters", "sale_gallons"]


def R(x):
    return f"ROUND(CAST({x} AS DOUBLE), 9)"


# The source has no NULLs, no large bottles and sales on every weekday; these
# lines do (the same in both engines), so the operators have work to do.
GAPPY_SQL = """gappy AS (SELECT * REPLACE (
    CASE WHEN itemno % 7 <> 0 THEN pack END AS pack, CASE WHEN store % 5 <> 0 THEN county END AS county,
    CASE WHEN itemno % 50 = 0 THEN 3000 ELSE bottle_volume_ml END AS bottle_volume_ml)
  FROM sales WHERE isodow(date) <> 7)"""


def gappy(spark, sf_dir):
    return sales(spark, sf_dir).where(F.weekday("date") != 6).withColumns({
        "pack": F.when(F.col("itemno") % 7 != 0, F.col("pack")),
        "county": F.when(F.col("store") % 5 != 0, F.col("county")),
        "bottle_volume_ml": F.when(F.col("itemno") % 50 == 0, F.lit(3000)).otherwise(F.col("bottle_volume_ml"))})


@register("d20_null_counts", sql=with_ctes(GAPPY_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS null_count FROM gappy" for c in ALL_COLS))
def d20_null_counts(spark, sf_dir):
    """NULL count of every column (one scan), long form."""
    counts = prof.shape_profile(gappy(spark, sf_dir))
    return counts.select("column", (F.col("row_count") - F.col("non_null")).alias("null_count"))


@register("b11_columns_with_nulls", sql=with_ctes(GAPPY_SQL) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS null_count FROM gappy" for c in ALL_COLS)
    + ") WHERE null_count > 0")
def b11_columns_with_nulls(spark, sf_dir):
    """Only the columns holding NULLs (metadata filter on the report)."""
    return null_report(gappy(spark, sf_dir))


_DTYPES = {"date": "date", "store": "bigint", "category": "bigint", "itemno": "bigint", "pack": "int", "bottle_volume_ml": "int",
           "sale_bottles": "int", **{c: "double" for c in ("state_bottle_cost", "state_bottle_retail", "sale_dollars",
                                                            "sale_liters", "sale_gallons")}}


@register("d22_shape_profile", sql=with_ctes() + " UNION ALL ".join(
    f"SELECT COUNT(*) AS row_count, '{c}' AS column, '{_DTYPES.get(c, 'string')}' AS dtype, COUNT({c}) AS non_null FROM sales"
    for c in ALL_COLS))
def d22_shape_profile(spark, sf_dir):
    """Row count, column names, types and non-NULL counts."""
    return prof.shape_profile(sales(spark, sf_dir))


@register("d21_describe", sql=with_ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(COUNT({c}) AS DOUBLE) AS count, {R(f'AVG({c})')} AS mean, "
    f"{R(f'STDDEV_SAMP({c})')} AS std, {R(f'MIN({c})')} AS min, "
    f"{R(f'QUANTILE_CONT({c}, 0.25)')} AS q25, {R(f'QUANTILE_CONT({c}, 0.5)')} AS q50, "
    f"{R(f'QUANTILE_CONT({c}, 0.75)')} AS q75, {R(f'MAX({c})')} AS max FROM sales" for c in NUMERIC))
def d21_describe(spark, sf_dir):
    """count / mean / std / min / quartiles / max of each numeric column."""
    return prof.describe(sales(spark, sf_dir), NUMERIC)


DOUBLES = {"state_bottle_cost", "state_bottle_retail", "sale_dollars", "sale_liters", "sale_gallons"}


@register("b02_numeric_columns", sql=with_ctes() + "SELECT " + ", ".join(
    f"{R(c)} AS {c}" if c in DOUBLES else c for c in NUMERIC) + " FROM sales")
def b02_numeric_columns(spark, sf_dir):
    """Projection on the numeric columns found from the schema."""
    s = sales(spark, sf_dir)
    return s.select(prof.numeric_columns(s))


def _corr_sql():
    parts = []
    for a, b in combinations_with_replacement(NUMERIC, 2):
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'CORR({a}, {b})')} AS value FROM sales")
        if a != b:
            parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {R(f'CORR({a}, {b})')} AS value FROM sales")
    return with_ctes() + " UNION ALL ".join(parts)


@register("d23_correlation_matrix", sql=_corr_sql())
def d23_correlation_matrix(spark, sf_dir):
    """Pairwise-complete Pearson matrix of the numeric columns (long)."""
    return prof.correlation_matrix(sales(spark, sf_dir), NUMERIC)


@register("d24_target_correlation", sql=with_ctes() + "SELECT feature, " + R("correlation") +
          " AS correlation, rank FROM (SELECT feature, correlation, CAST(ROW_NUMBER() OVER "
          "(ORDER BY ROUND(correlation, 9) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS feature, CORR(sale_dollars, {c}) AS correlation FROM sales" for c in NUMERIC)
          + ")) WHERE rank BETWEEN 2 AND 16")
def d24_target_correlation(spark, sf_dir):
    """Correlation with sale_dollars, ranked, ranks 2–16 (self excluded)."""
    return prof.target_correlations(sales(spark, sf_dir), "sale_dollars", NUMERIC)


@register("d25_contingency", sql=with_ctes() + "SELECT county AS a, category_name AS b, COUNT(*) AS n "
          "FROM sales WHERE county IS NOT NULL AND category_name IS NOT NULL GROUP BY 1, 2")
def d25_contingency(spark, sf_dir):
    """Long contingency table county × category_name."""
    return prof.contingency(sales(spark, sf_dir), "county", "category_name")


def _cramers_sql_part(a: str, b: str, idx: int) -> str:
    t = f"ct{idx}"
    return f"""{t} AS (SELECT {a} AS a, {b} AS b, COUNT(*) AS n FROM sales
     WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
{t}_c AS (SELECT *, SUM(n) OVER (PARTITION BY a) AS R, SUM(n) OVER (PARTITION BY b) AS C FROM {t}),
{t}_s AS (SELECT CAST(SUM(n) AS DOUBLE) AS nt, SUM(CAST(n AS DOUBLE) * n / (CAST(R AS DOUBLE) * C)) AS s,
     COUNT(DISTINCT a) AS r, COUNT(DISTINCT b) AS c,
     CAST(COALESCE(SUM(n) FILTER (WHERE a = (SELECT MIN(a) FROM {t}) AND b = (SELECT MIN(b) FROM {t})), 0) AS DOUBLE) AS o11,
     CAST(MAX(R) FILTER (WHERE a = (SELECT MIN(a) FROM {t})) AS DOUBLE) AS r1,
     CAST(MAX(C) FILTER (WHERE b = (SELECT MIN(b) FROM {t})) AS DOUBLE) AS c1 FROM {t}_c),
{t}_x AS (SELECT *, CASE WHEN r = 2 AND c = 2 THEN
       POW(GREATEST(ABS(o11 - r1 * c1 / nt) - 0.5, 0.0), 2) * nt * (1.0 / r1 + 1.0 / (nt - r1)) * (1.0 / c1 + 1.0 / (nt - c1))
     WHEN r >= 2 AND c >= 2 THEN nt * (s - 1.0) ELSE 0.0 END AS chi2, LEAST(r, c) - 1 AS k FROM {t}_s),
{t}_v AS (SELECT '{a}' AS col_a, '{b}' AS col_b, chi2,
     CASE WHEN k > 0 THEN SQRT(GREATEST(chi2, 0.0) / (nt * k)) END AS cramers_v, CAST(nt AS BIGINT) AS n FROM {t}_x)"""


@register("d26_cramers_v", sql=with_ctes(_cramers_sql_part("store_location", "category_name", 0))
          + f"SELECT col_a, col_b, {R('chi2')} AS chi2, {R('cramers_v')} AS cramers_v, n FROM ct0_v")
def d26_cramers_v(spark, sf_dir):
    """Chi-square and Cramér's V of store_location × category_name."""
    return prof.cramers_v(sales(spark, sf_dir), "store_location", "category_name")


def _cramers_matrix_sql():
    pairs = list(combinations_with_replacement(CATEGORICAL, 2))
    ctes = [_cramers_sql_part(a, b, i) for i, (a, b) in enumerate(pairs)]
    sel = []
    for i, (a, b) in enumerate(pairs):
        sel.append(f"SELECT col_a, col_b, {R('cramers_v')} AS cramers_v FROM ct{i}_v")
        if a != b:
            sel.append(f"SELECT col_b AS col_a, col_a AS col_b, {R('cramers_v')} AS cramers_v FROM ct{i}_v")
    return with_ctes(*ctes) + " UNION ALL ".join(sel)


@register("d27_cramers_v_matrix", sql=_cramers_matrix_sql())
def d27_cramers_v_matrix(spark, sf_dir):
    """Symmetric Cramér's V matrix over four categorical columns (long)."""
    return prof.cramers_v_matrix(sales(spark, sf_dir), CATEGORICAL)


@register("d28_histogram", sql=with_ctes("""mm AS (SELECT CAST(MIN(bottle_volume_ml) AS DOUBLE) AS lo,
    CAST(MAX(bottle_volume_ml) AS DOUBLE) AS hi FROM sales)""", """hc AS (
  SELECT CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((bottle_volume_ml - lo) / (hi - lo) * 50) AS INTEGER), 49) END AS bin,
         COUNT(*) AS n FROM sales, mm WHERE bottle_volume_ml IS NOT NULL GROUP BY 1)""") + f"""
SELECT CAST(d.bin AS INTEGER) AS bin, {R('lo + d.bin * (hi - lo) / 50.0')} AS bin_start,
       {R('lo + (d.bin + 1) * (hi - lo) / 50.0')} AS bin_end, CAST(COALESCE(hc.n, 0) AS BIGINT) AS count
FROM (SELECT range AS bin FROM range(50)) d CROSS JOIN mm LEFT JOIN hc ON hc.bin = d.bin""")
def d28_histogram(spark, sf_dir):
    """50 equal-width bins of bottle_volume_ml, last bin closed."""
    return prof.histogram(sales(spark, sf_dir), "bottle_volume_ml", 50)


@register("d29_box_summary", sql=with_ctes("""pu AS (SELECT category_name,
    sale_dollars / NULLIF(CAST(sale_bottles AS DOUBLE), 0) AS v FROM sales)""", """bq AS (
  SELECT category_name, COUNT(v) AS n, QUANTILE_CONT(v, 0.25) AS q1, QUANTILE_CONT(v, 0.5) AS median,
         QUANTILE_CONT(v, 0.75) AS q3 FROM pu WHERE v IS NOT NULL GROUP BY 1)""", """bw AS (
  SELECT p.category_name,
    MIN(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
    MAX(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    COUNT(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
  FROM pu p JOIN bq USING (category_name) WHERE v IS NOT NULL GROUP BY 1)""") + f"""
SELECT category_name, n, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
  {R('whisker_low')} AS whisker_low, {R('whisker_high')} AS whisker_high, outliers
FROM bq JOIN bw USING (category_name)""")
def d29_box_summary(spark, sf_dir):
    """Box-plot summary of price per unit by category."""
    return prof.box_summary(prof.price_per_unit(sales(spark, sf_dir)), "category_name", "price_per_unit")


@register("i10_profile_report", sql=with_ctes(GAPPY_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, {R(f'AVG({c})')} AS mean, "
    f"{R(f'STDDEV_SAMP({c})')} AS std, {R(f'MIN({c})')} AS min, {R(f'QUANTILE_CONT({c}, 0.25)')} AS q25, "
    f"{R(f'QUANTILE_CONT({c}, 0.5)')} AS q50, {R(f'QUANTILE_CONT({c}, 0.75)')} AS q75, {R(f'MAX({c})')} AS max, "
    f"{R(f'CORR({c}, sale_dollars)')} AS with_sales FROM gappy" for c in NUMERIC))
def i10_profile_report(spark, sf_dir):
    """One profile call over lines with gaps: its tables of shape, nulls,
    moments, quartiles and correlations, joined by column."""
    p = prof.profile_report(gappy(spark, sf_dir).select(*NUMERIC, *CATEGORICAL), NUMERIC)
    with_sales = p.correlations.where("col_a = 'sale_dollars'").select(F.col("col_b").alias("column"), F.col("value").alias("with_sales"))
    return (p.describe.drop("count").join(p.nulls, "column").join(p.shape.select("column", "row_count"), "column").join(with_sales, "column")
            .select("column", "row_count", "null_count", "mean", "std", "min", "q25", "q50", "q75", "max", "with_sales"))


@register("h13_price_per_unit", sql=with_ctes() + "SELECT invoice_line_no, itemno, store, date, "
          + R("sale_dollars / NULLIF(CAST(sale_bottles AS DOUBLE), 0)") + " AS price_per_unit FROM sales")
def h13_price_per_unit(spark, sf_dir):
    """Unguarded ratio made safe: dollars per bottle, zero bottles → NULL."""
    return prof.price_per_unit(sales(spark, sf_dir)).select(
        "invoice_line_no", "itemno", "store", "date", "price_per_unit")


@register("d13_monthly_totals", sql=with_ctes() + """SELECT CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, ROUND(COALESCE(SUM(sale_dollars), 0), 9) AS total_sale_dollars,
  make_date(CAST(year(date) AS INTEGER), CAST(month(date) AS INTEGER), 1) AS month_start
FROM sales GROUP BY 1, 2""")
def d13_monthly_totals(spark, sf_dir):
    """Sales by (year, month) with the first-of-month date."""
    return agg.monthly_totals(sales(spark, sf_dir))


@register("d14_weekday_totals", sql=with_ctes(GAPPY_SQL) + """SELECT d.weekday_pos, d.weekday,
  ROUND(t.total, 9) AS total_sale_dollars
FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
             (5, 'Saturday'), (6, 'Sunday')) d(weekday_pos, weekday)
LEFT JOIN (SELECT dayname(date) AS weekday, SUM(sale_dollars) AS total FROM gappy GROUP BY 1) t
  ON t.weekday = d.weekday""")
def d14_weekday_totals(spark, sf_dir):
    """Sales by weekday name over the fixed Monday…Sunday order (no Sundays)."""
    return agg.weekday_totals(gappy(spark, sf_dir))


def _totals_sql(key):
    return with_ctes() + f"SELECT {key}, ROUND(COALESCE(SUM(sale_dollars), 0), 9) AS total_sale_dollars FROM sales GROUP BY 1"


@register("d15_category_totals", sql=_totals_sql("category_name"))
def d15_category_totals(spark, sf_dir):
    """Sales by category, largest first."""
    return agg.totals_by(sales(spark, sf_dir), "category_name")


@register("d16_store_totals", sql=_totals_sql("store"))
def d16_store_totals(spark, sf_dir):
    """Sales by store."""
    return agg.totals_by(sales(spark, sf_dir), "store")


@register("d16_county_totals", sql=_totals_sql("county"))
def d16_county_totals(spark, sf_dir):
    """Sales by county."""
    return agg.totals_by(sales(spark, sf_dir), "county")


def _top_sql(key, k=10):
    return with_ctes() + (f"SELECT {key}, ROUND(total, 9) AS total_sale_dollars FROM (SELECT {key}, "
                          f"COALESCE(SUM(sale_dollars), 0) AS total FROM sales GROUP BY 1) "
                          f"ORDER BY total DESC, {key} LIMIT {k}")


@register("f04_top10_stores", sql=_top_sql("store"))
def f04_top10_stores(spark, sf_dir):
    """The 10 stores with the largest sales (top-k report)."""
    return agg.top_k(sales(spark, sf_dir), "store", 10)


@register("f04_top10_counties", sql=_top_sql("county"))
def f04_top10_counties(spark, sf_dir):
    """The 10 counties with the largest sales (top-k report)."""
    return agg.top_k(sales(spark, sf_dir), "county", 10)


ITEM_DAY_SQL = """item_day AS (
  SELECT store, itemno, date,
    MIN({'i': invoice_line_no, 'v': pack}) FILTER (WHERE pack IS NOT NULL).v AS pack,
    MIN({'i': invoice_line_no, 'v': bottle_volume_ml}) FILTER (WHERE bottle_volume_ml IS NOT NULL).v AS bottle_volume_ml,
    CAST(COALESCE(SUM(sale_bottles), 0) AS BIGINT) AS sale_bottles
  FROM sales WHERE store IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2, 3
)"""


@register("d17_item_day", sql=with_ctes(ITEM_DAY_SQL) + "SELECT * FROM item_day")
def d17_item_day(spark, sf_dir):
    """(store, itemno, date) roll-up: first pack / volume, bottle total."""
    return agg.item_day(sales(spark, sf_dir))


@register("d18_value_counts", sql=with_ctes(ITEM_DAY_SQL) + "SELECT store, COUNT(*) AS count FROM item_day GROUP BY 1")
def d18_value_counts(spark, sf_dir):
    """Frequency of stores among (store, item, day) rows."""
    return agg.value_counts(agg.item_day(sales(spark, sf_dir)), "store")


@register("f05_top_store_item", sql=with_ctes(ITEM_DAY_SQL, """ts AS (
  SELECT store FROM item_day GROUP BY store ORDER BY COUNT(*) DESC, store LIMIT 1)""", """ti AS (
  SELECT itemno FROM item_day WHERE store = (SELECT store FROM ts)
  GROUP BY itemno ORDER BY COUNT(*) DESC, itemno LIMIT 1)""") +
    "SELECT * FROM item_day WHERE store = (SELECT store FROM ts) AND itemno = (SELECT itemno FROM ti)")
def f05_top_store_item(spark, sf_dir):
    """Rows of the busiest store's busiest item (top-1 by frequency twice;
    ties → smallest key)."""
    d = cut_lineage(agg.item_day(sales(spark, sf_dir)))
    top_store = agg.top1_by_frequency(d, "store")
    d = d.join(F.broadcast(top_store), "store", "left_semi")  # one row
    top_item = agg.top1_by_frequency(d, "itemno")
    return d.join(F.broadcast(top_item), "itemno", "left_semi")  # one row


@register("d33_distinct_dates", sql=with_ctes() + "SELECT DISTINCT date FROM sales")
def d33_distinct_dates(spark, sf_dir):
    """Distinct dates."""
    return agg.distinct_values(sales(spark, sf_dir), "date")


@register("g02_distinct_item_records", sql=with_ctes() + """SELECT DISTINCT store, date, category_name,
  im_desc, pack, bottle_volume_ml, ROUND(state_bottle_cost, 9) AS state_bottle_cost,
  ROUND(state_bottle_retail, 9) AS state_bottle_retail, ROUND(sale_dollars, 9) AS sale_dollars,
  sale_bottles, ROUND(sale_liters, 9) AS sale_liters, ROUND(sale_gallons, 9) AS sale_gallons FROM sales""")
def g02_distinct_item_records(spark, sf_dir):
    """DISTINCT item records per store-day (the rows behind item_details)."""
    return agg.distinct_values(sales(spark, sf_dir), "store", "date", *agg.ITEM_DETAIL_FIELDS)


@register("m10_category_buckets", sql=with_ctes(GAPPY_SQL, """ct AS (SELECT category_name, SUM(sale_dollars) AS t FROM gappy GROUP BY 1)""",
    """g AS (SELECT SUM(sale_dollars) AS g FROM gappy)""") + """SELECT s.invoice_line_no, s.itemno, s.category_name,
  CASE WHEN ct.t / NULLIF(g.g, 0) < 0.2 THEN 'Other' ELSE s.category_name END AS category_name_grouped,
  CASE WHEN s.bottle_volume_ml > 2000 THEN 'large format' ELSE 'standard' END AS volume_class
FROM gappy s LEFT JOIN ct ON ct.category_name = s.category_name CROSS JOIN g""")
def m10_category_buckets(spark, sf_dir):
    """Low-share categories (< 20 % of sales here) → 'Other'; bottles over
    2000 ml → 'large format'."""
    s = prof.volume_class(prof.bucket_small_categories(gappy(spark, sf_dir), min_share=0.2))
    return s.select("invoice_line_no", "itemno", "category_name", "category_name_grouped", "volume_class")
