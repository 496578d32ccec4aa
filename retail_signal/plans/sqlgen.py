"""SQL text for the oracle twins (DuckDB dialect, ANSI where possible).

Only string building: the SQL is handed to an independent engine to check
the Spark results; nothing here plans or executes anything.
"""

from __future__ import annotations

from ..operators.aggregate import STORE_ATTRIBUTES, STORE_DAY_AGGS, agg_name

# Source columns of ``sales`` that are doubles (others are integers/strings).
DOUBLE_SOURCE = {"sale_dollars", "sale_liters", "sale_gallons",
                 "state_bottle_cost", "state_bottle_retail"}
INT_SOURCE = {"sale_bottles", "pack", "bottle_volume_ml"}


def agg_sql(column: str, agg: str) -> tuple[str, bool]:
    """(expression, is_double) of one pandas-style aggregate."""
    c = column
    if agg == "sum":
        if c in DOUBLE_SOURCE:
            return f"COALESCE(SUM({c}), 0)", True
        return f"CAST(COALESCE(SUM({c}), 0) AS BIGINT)", False
    if agg == "mean":
        return f"AVG({c})", True
    if agg == "median":
        return f"QUANTILE_CONT({c}, 0.5)", True
    if agg == "std":
        return f"STDDEV_SAMP({c})", True
    if agg in ("min", "max"):
        return f"{agg.upper()}({c})", c in DOUBLE_SOURCE
    if agg == "skew":
        return f"CASE WHEN COUNT({c}) >= 3 THEN COALESCE(SKEWNESS({c}), 0) END", True
    if agg == "sem":
        return f"STDDEV_SAMP({c}) / SQRT(COUNT({c}))", True
    if agg == "count":
        return f"COUNT({c})", False
    if agg == "nunique":
        return f"COUNT(DISTINCT {c})", False
    raise ValueError(agg)


def rnd(expr: str, is_double: bool = True) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 9)" if is_double else expr


def store_day_agg_items() -> list[tuple[str, str, bool]]:
    """(expression, alias, is_double) for the 60 store-day aggregates."""
    return [(e, agg_name(c, a), d) for c, aggs in STORE_DAY_AGGS for a in aggs
            for e, d in [agg_sql(c, a)]]


def store_day_agg_cte(name: str = "sd_aggs") -> str:
    items = ",\n    ".join(f"{e} AS {a}" for e, a, _ in store_day_agg_items())
    return f"""{name} AS (
  SELECT store, date,
    {items}
  FROM sales WHERE store IS NOT NULL AND date IS NOT NULL
  GROUP BY store, date
)"""


def store_day_cte(name: str = "store_day") -> str:
    """I1 in SQL: aggregates, per-store first attributes, lon/lat, ratios
    with global-median fills, and the number of distinct item records."""
    attrs = ",\n    ".join(
        f"ARG_MIN({a}, date) FILTER (WHERE {a} IS NOT NULL) AS {a}" for a in STORE_ATTRIBUTES)
    items = ", ".join(["category_name", "im_desc", "pack", "bottle_volume_ml",
                       "state_bottle_cost", "state_bottle_retail", "sale_dollars",
                       "sale_bottles", "sale_liters", "sale_gallons"])
    return f"""{store_day_agg_cte('sd_aggs')},
sd_attrs AS (
  SELECT store,
    {attrs}
  FROM sales WHERE store IS NOT NULL AND date IS NOT NULL GROUP BY store
),
sd_items AS (
  SELECT store, date, COUNT(*) AS item_details_count
  FROM (SELECT DISTINCT store, date, {items} FROM sales
        WHERE store IS NOT NULL AND date IS NOT NULL) GROUP BY store, date
),
sd_raw AS (
  SELECT a.*, t.name, t.address, t.city, t.zipcode, t.store_location, t.county,
    i.item_details_count,
    CAST(REPLACE(t.store_location, '''', '"')::JSON->'coordinates'->>0 AS DOUBLE) AS lon,
    CAST(REPLACE(t.store_location, '''', '"')::JSON->'coordinates'->>1 AS DOUBLE) AS lat,
    a.sale_dollars / NULLIF(CAST(a.sale_bottles AS DOUBLE), 0) AS avg_price_per_bottle,
    a.sale_dollars / NULLIF(CAST(a.sale_liters AS DOUBLE), 0) AS avg_price_per_liter,
    a.unique_items / NULLIF(CAST(a.transaction_count AS DOUBLE), 0) AS avg_items_per_transaction
  FROM sd_aggs a JOIN sd_attrs t USING (store) JOIN sd_items i USING (store, date)
),
{name} AS (
  SELECT * REPLACE (
    COALESCE(avg_price_per_bottle, (SELECT QUANTILE_CONT(avg_price_per_bottle, 0.5) FROM sd_raw)) AS avg_price_per_bottle,
    COALESCE(avg_price_per_liter, (SELECT QUANTILE_CONT(avg_price_per_liter, 0.5) FROM sd_raw)) AS avg_price_per_liter,
    COALESCE(avg_items_per_transaction, (SELECT QUANTILE_CONT(avg_items_per_transaction, 0.5) FROM sd_raw)) AS avg_items_per_transaction)
  FROM sd_raw
)"""


def store_day_columns() -> list[tuple[str, bool]]:
    """(column, is_double) of the ``store_day`` SQL CTE, item array as count."""
    cols = [("store", False), ("date", False)] + [(a, False) for a in STORE_ATTRIBUTES]
    cols += [("item_details_count", False)]
    cols += [(a, d) for _, a, d in store_day_agg_items()]
    cols += [("lon", True), ("lat", True), ("avg_price_per_bottle", True),
             ("avg_price_per_liter", True), ("avg_items_per_transaction", True)]
    return cols


def select_rounded(cols: list[tuple[str, bool]], source: str, where: str = "") -> str:
    items = ",\n  ".join(f"{rnd(c, d)} AS {c}" if d else c for c, d in cols)
    return f"SELECT\n  {items}\nFROM {source} {where}"


def temporal_cte(source: str, name: str = "temporal", target: str = "sale_dollars",
                 key: str = "store", lags=(1, 7, 14, 30, 60),
                 windows=(7, 14, 30, 60, 90)) -> str:
    """I3 in SQL over ``source(key, date, target, ...)``."""
    w = f"PARTITION BY {key} ORDER BY _dn"
    parts = []
    for k in lags:
        parts.append(f"FIRST({target}) OVER ({w} RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) "
                     f"AS {target}_lag_{k}d")
    gap = (f"CAST(DATEDIFF('day', MIN(date) OVER (PARTITION BY {key}), MAX(date) OVER (PARTITION BY {key})) AS DOUBLE)"
           f" / NULLIF(COUNT(*) OVER (PARTITION BY {key}) - 1, 0)")
    for d in windows:
        fr = f"({w} RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
        lab = f"{d}D"
        parts += [f"AVG({target}) OVER {fr} AS {target}_rolling_mean_{lab}",
                  f"STDDEV_SAMP({target}) OVER {fr} AS {target}_rolling_std_{lab}",
                  f"MAX({target}) OVER {fr} AS {target}_rolling_max_{lab}",
                  f"MIN({target}) OVER {fr} AS {target}_rolling_min_{lab}",
                  f"QUANTILE_CONT({target}, 0.5) OVER {fr} AS {target}_rolling_median_{lab}",
                  f"{gap} AS avg_days_between_purchases_{lab}"]
    parts += [f"LAG({target}, 1) OVER ({w}) AS _prev1",
              f"LAG({target}, 2) OVER ({w}) AS _prev2",
              f"LAG(date, 1) OVER ({w}) AS _prev_date"]
    inner = ",\n    ".join(parts)

    def flag(cond):
        return f"CAST(COALESCE(CAST({cond} AS INTEGER), 0) AS INTEGER)"

    t = target
    der = []
    for d in windows:
        lab = f"{d}D"
        der.append(f"{t} - {t}_rolling_mean_{lab} AS {t}_momentum_{lab}")
        der.append(f"({t} / NULLIF({t}_rolling_mean_{lab}, 0) - 1) * 100 AS {t}_rel_momentum_{lab}")
    der += [
        "CAST(DATEDIFF('day', _prev_date, date) AS INTEGER) AS days_since_last_purchase",
        f"{flag(f'{t} < {t}_lag_1d')} AS {t}_decrease_prev",
        f"{flag(f'{t} < {t}_rolling_mean_7D')} AS {t}_decrease_7d_avg",
        f"{flag(f'{t} < {t}_rolling_mean_30D')} AS {t}_decrease_30d_avg",
        f"{flag(f'{t} < {t}_rolling_mean_30D * 0.9')} AS {t}_significant_decrease",
        f"{flag(f'({t} < _prev1) AND (_prev1 < _prev2)')} AS consecutive_decrease",
        "SIN(2 * PI() * MONTH(date) / 12) AS month_sin",
        "COS(2 * PI() * MONTH(date) / 12) AS month_cos",
        "SIN(2 * PI() * DAYOFMONTH(date) / 31) AS day_of_month_sin",
        "COS(2 * PI() * DAYOFMONTH(date) / 31) AS day_of_month_cos",
    ]
    derived = ",\n    ".join(der)
    return f"""{name}_w AS (
  SELECT *,
    {inner}
  FROM (SELECT *, DATEDIFF('day', DATE '1970-01-01', date) AS _dn FROM {source})
),
{name} AS (
  SELECT * EXCLUDE (_dn, _prev1, _prev2, _prev_date),
    {derived}
  FROM {name}_w
)"""


def temporal_columns(target: str = "sale_dollars", lags=(1, 7, 14, 30, 60),
                     windows=(7, 14, 30, 60, 90)) -> list[tuple[str, bool]]:
    t = target
    cols = [(f"{t}_lag_{k}d", True) for k in lags]
    for d in windows:
        lab = f"{d}D"
        cols += [(f"{t}_rolling_{s}_{lab}", True) for s in ("mean", "std", "max", "min", "median")]
        cols += [(f"avg_days_between_purchases_{lab}", True)]
    for d in windows:
        lab = f"{d}D"
        cols += [(f"{t}_momentum_{lab}", True), (f"{t}_rel_momentum_{lab}", True)]
    cols += [("days_since_last_purchase", False), (f"{t}_decrease_prev", False),
             (f"{t}_decrease_7d_avg", False), (f"{t}_decrease_30d_avg", False),
             (f"{t}_significant_decrease", False), ("consecutive_decrease", False),
             ("month_sin", True), ("month_cos", True), ("day_of_month_sin", True),
             ("day_of_month_cos", True)]
    return cols


# ---------------------------------------------------------------------------
# Calendar, holidays, prices
# ---------------------------------------------------------------------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def us_calendar_sql(source: str, name: str = "holidays") -> str:
    """Rule-based US holidays for the years of ``source.date``."""
    from ..operators.calendar import OBSERVED_SUFFIX, US_HOLIDAY_RULES
    sel = []
    for hname, rule in US_HOLIDAY_RULES:
        kind = rule[0]
        if kind == "fixed":
            _, m, d, since = rule
            day = f"make_date(gy, {m}, {d})"
            sel.append(f"SELECT {day} AS h, {_sql_str(hname)} AS name FROM {name}_gen WHERE gy >= {since}")
            obs = (f"CASE isodow({day}) WHEN 6 THEN {day} - 1 WHEN 7 THEN {day} + 1 END")
            sel.append(f"SELECT {obs} AS h, {_sql_str(hname + OBSERVED_SUFFIX)} AS name FROM {name}_gen "
                       f"WHERE gy >= {since} AND isodow({day}) IN (6, 7)")
        elif kind == "nth":
            _, m, wd, n, since = rule
            first = f"make_date(gy, {m}, 1)"
            day = f"{first} + CAST((({wd} - (isodow({first}) - 1)) % 7 + 7) % 7 + {7 * (n - 1)} AS INTEGER)"
            sel.append(f"SELECT {day} AS h, {_sql_str(hname)} AS name FROM {name}_gen WHERE gy >= {since}")
        else:
            _, m, wd, since = rule
            last = f"last_day(make_date(gy, {m}, 1))"
            day = f"{last} - CAST((((isodow({last}) - 1) - {wd}) % 7 + 7) % 7 AS INTEGER)"
            sel.append(f"SELECT {day} AS h, {_sql_str(hname)} AS name FROM {name}_gen WHERE gy >= {since}")
    union = "\n  UNION ALL ".join(sel)
    return f"""{name}_years AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y FROM {source} WHERE date IS NOT NULL),
{name}_gen AS (SELECT DISTINCT y + o AS gy FROM {name}_years, (VALUES (-1), (0), (1)) t(o)),
{name} AS (
  SELECT CAST(h AS DATE) AS h, name FROM (
  {union}
  ) WHERE CAST(year(h) AS INTEGER) IN (SELECT y FROM {name}_years)
)"""


def holiday_features_sql(source: str, name: str = "hol_feats", window_days: int = 3) -> str:
    """Brute-force twin of ``nearest_holidays``: every date against every
    holiday of the data years year−1 … year+1."""
    return f"""{us_calendar_sql(source, 'holidays')},
{name}_dates AS (SELECT DISTINCT date AS d FROM {source} WHERE date IS NOT NULL),
{name}_pairs AS (
  SELECT d.d, year(h.h) AS cy, CAST(h.h - d.d AS INTEGER) AS diff, h.name
  FROM {name}_dates d JOIN holidays h ON year(h.h) BETWEEN year(d.d) - 1 AND year(d.d) + 1
),
{name}_year AS (
  SELECT d, cy, arg_min(diff, abs(diff) * 2 + CASE WHEN diff < 0 THEN 0 ELSE 1 END) AS diff,
         arg_min(name, abs(diff) * 2 + CASE WHEN diff < 0 THEN 0 ELSE 1 END) AS name
  FROM {name}_pairs GROUP BY d, cy
),
{name}_agg AS (
  SELECT d,
    MAX(CAST(abs(diff) <= {window_days} AS INTEGER)) AS is_holiday,
    MAX(CAST(diff = 1 AS INTEGER)) AS is_day_before_holiday,
    MAX(CAST(diff = -1 AS INTEGER)) AS is_day_after_holiday,
    arg_min(diff, abs(diff) * 2 + CASE WHEN diff < 0 THEN 0 ELSE 1 END) AS dn,
    arg_min(name, abs(diff) * 2 + CASE WHEN diff < 0 THEN 0 ELSE 1 END) AS nn
  FROM {name}_year GROUP BY d
),
{name} AS (
  SELECT d.d AS date,
    CAST(COALESCE(a.is_holiday, 0) AS INTEGER) AS is_holiday,
    COALESCE(CASE WHEN abs(a.dn) <= {window_days} THEN a.nn ELSE '' END, '') AS holiday_name,
    CAST(COALESCE(a.is_day_before_holiday, 0) AS INTEGER) AS is_day_before_holiday,
    CAST(COALESCE(a.is_day_after_holiday, 0) AS INTEGER) AS is_day_after_holiday,
    CAST(a.dn AS INTEGER) AS days_to_nearest_holiday
  FROM {name}_dates d LEFT JOIN {name}_agg a ON a.d = d.d
)"""


def date_parts_sql(d: str = "date") -> str:
    return (f"CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week, CAST(month({d}) AS INTEGER) AS month, "
            f"CAST(quarter({d}) AS INTEGER) AS quarter, CAST(year({d}) AS INTEGER) AS year, "
            f"CAST(isodow({d}) >= 6 AS INTEGER) AS is_weekend, CAST(day({d}) AS INTEGER) AS day_of_month, "
            f"CAST(weekofyear({d}) AS INTEGER) AS week_of_year")


def median_fill_sql(source: str, name: str, cols: list[str]) -> str:
    rep = ",\n    ".join(
        f"COALESCE({c}, (SELECT QUANTILE_CONT({c}, 0.5) FROM {source})) AS {c}" for c in cols)
    return f"""{name} AS (
  SELECT * REPLACE (
    {rep})
  FROM {source}
)"""


def basic_features_sql(source: str, name: str = "basic") -> str:
    prices = """sale_dollars / NULLIF(CAST(sale_bottles AS DOUBLE), 0) AS avg_price_per_bottle,
    sale_dollars / NULLIF(CAST(sale_liters AS DOUBLE), 0) AS avg_price_per_liter,
    (state_bottle_retail_mean - state_bottle_cost_mean) / NULLIF(state_bottle_retail_mean, 0) AS profit_margin,
    state_bottle_retail_mean / NULLIF(state_bottle_cost_mean, 0) AS discount_factor,
    sale_dollars / NULLIF(CAST(transaction_count AS DOUBLE), 0) AS avg_transaction_value"""
    fill_cols = ["avg_price_per_bottle", "avg_price_per_liter", "profit_margin",
                 "discount_factor", "avg_transaction_value"]
    return f"""{holiday_features_sql(source)},
{name}_raw AS (
  SELECT s.* EXCLUDE (avg_price_per_bottle, avg_price_per_liter), {date_parts_sql('s.date')},
    h.is_holiday, h.holiday_name, h.is_day_before_holiday, h.is_day_after_holiday,
    h.days_to_nearest_holiday,
    {prices}
  FROM {source} s LEFT JOIN hol_feats h ON h.date = s.date
),
{median_fill_sql(name + '_raw', name + '_filled', fill_cols)},
{name} AS (
  SELECT * REPLACE (CAST(COALESCE(days_to_nearest_holiday, 60) AS INTEGER) AS days_to_nearest_holiday)
  FROM {name}_filled
)"""


def basic_feature_columns() -> list[tuple[str, bool]]:
    return [("day_of_week", False), ("month", False), ("quarter", False), ("year", False),
            ("is_weekend", False), ("day_of_month", False), ("week_of_year", False),
            ("is_holiday", False), ("holiday_name", False), ("is_day_before_holiday", False),
            ("is_day_after_holiday", False), ("days_to_nearest_holiday", False),
            ("profit_margin", True), ("discount_factor", True), ("avg_transaction_value", True)]


# ---------------------------------------------------------------------------
# I4 store features, I5 fills
# ---------------------------------------------------------------------------

def store_features_sql(source: str, name: str = "storef") -> str:
    return f"""{name}_a AS (
  SELECT * EXCLUDE (store_location),
    AVG(sale_dollars) OVER (PARTITION BY store) AS store_avg_sales,
    AVG(transaction_count) OVER (PARTITION BY store) AS store_avg_transactions,
    AVG(unique_items) OVER (PARTITION BY store) AS store_avg_items
  FROM {source}
),
{name}_q AS (SELECT QUANTILE_CONT(store_avg_sales, [0.33, 0.66]) AS q FROM {name}_a),
{name}_city AS (SELECT city, AVG(sale_dollars) AS city_avg_sales FROM {name}_a WHERE city IS NOT NULL GROUP BY city),
{name}_county AS (SELECT county, AVG(sale_dollars) AS county_avg_sales FROM {name}_a WHERE county IS NOT NULL GROUP BY county),
{name}_b AS (
  SELECT a.*,
    CAST(CASE WHEN a.store_avg_sales > (SELECT q[2] FROM {name}_q) THEN 3
              WHEN a.store_avg_sales > (SELECT q[1] FROM {name}_q) THEN 2 ELSE 1 END AS INTEGER) AS store_size,
    c.city_avg_sales, k.county_avg_sales,
    COALESCE(a.store_avg_sales / NULLIF(c.city_avg_sales, 0), 1.0) AS store_to_city_sales_ratio,
    COALESCE(a.store_avg_sales / NULLIF(k.county_avg_sales, 0), 1.0) AS store_to_county_sales_ratio,
    a.unique_items / NULLIF(CAST(a.transaction_count AS DOUBLE), 0) AS items_per_transaction_ratio
  FROM {name}_a a LEFT JOIN {name}_city c ON a.city = c.city LEFT JOIN {name}_county k ON a.county = k.county
),
{median_fill_sql(name + '_b', name, ['items_per_transaction_ratio'])}"""


def store_feature_columns() -> list[tuple[str, bool]]:
    return [("lon", True), ("lat", True), ("store_avg_sales", True), ("store_size", False),
            ("city_avg_sales", True), ("county_avg_sales", True), ("store_avg_transactions", True),
            ("store_to_city_sales_ratio", True), ("store_to_county_sales_ratio", True),
            ("store_avg_items", True), ("items_per_transaction_ratio", True)]


def fill_sql(source: str, name: str, cols: list[str], key: str = "store") -> str:
    w = f"PARTITION BY {key} ORDER BY date"
    rep = ",\n    ".join(
        f"COALESCE({c}, FIRST({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
        f"LAST({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {c}"
        for c in cols)
    return f"""{name} AS (
  SELECT * REPLACE (
    {rep})
  FROM {source}
)"""
