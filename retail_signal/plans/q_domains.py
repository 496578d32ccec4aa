"""Registered proposal-level queries (M1–M9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import domains as dm
from ..operators.aggregate import store_attributes, store_day_some
from ..operators.temporal import temporal_features
from ..session import cut_lineage
from .q_temporal import DAILY_SQL, TEMPORAL_SQL, daily_totals
from .registry import register, sales, with_ctes
from .sqlgen import store_day_cte

DATE_CUT = "1999-01-01"
SHIFT_FEATURES = ["sale_dollars", "transaction_count", "unique_items"]


def _sd(spark, sf_dir):
    """The few store-day columns that the domain measures read."""
    return cut_lineage(store_day_some(sales(spark, sf_dir), [*SHIFT_FEATURES, "bottle_volume_ml_mean"]))


def _tf(spark, sf_dir):
    return temporal_features(daily_totals(spark, sf_dir))


@register("m01_store_groups", sql=with_ctes(store_day_cte(), """p AS (
  SELECT store, COUNT(*) AS n, AVG(sale_dollars) AS store_avg_sales, AVG(transaction_count) AS store_avg_transactions,
    AVG(unique_items) AS store_avg_items, AVG(bottle_volume_ml_mean) AS avg_bottle_volume_ml FROM store_day GROUP BY store)""",
    """q AS (SELECT QUANTILE_CONT(p.store_avg_sales, [0.33, 0.66]) AS q FROM store_day JOIN p USING (store))""")
    + """SELECT store, ROUND(store_avg_sales, 9) AS store_avg_sales, ROUND(store_avg_transactions, 9) AS store_avg_transactions,
  ROUND(store_avg_items, 9) AS store_avg_items, ROUND(avg_bottle_volume_ml, 9) AS avg_bottle_volume_ml,
  CAST(CASE WHEN store_avg_sales > (SELECT q[2] FROM q) THEN 3 WHEN store_avg_sales > (SELECT q[1] FROM q) THEN 2 ELSE 1 END AS INTEGER) AS store_size,
  CASE WHEN avg_bottle_volume_ml > 1000 THEN 'large' ELSE 'standard' END AS volume_tier,
  'size' || CAST(CASE WHEN store_avg_sales > (SELECT q[2] FROM q) THEN 3 WHEN store_avg_sales > (SELECT q[1] FROM q) THEN 2 ELSE 1 END AS VARCHAR)
    || '_' || CASE WHEN avg_bottle_volume_ml > 1000 THEN 'large' ELSE 'standard' END AS store_group FROM p""")
def m01_store_groups(spark, sf_dir):
    """Store groups by size class and bottle-volume tier."""
    return dm.store_groups(_sd(spark, sf_dir))


@register("m02_domain_split", sql=with_ctes(DAILY_SQL) + f"""SELECT store, date, ROUND(sale_dollars, 9) AS sale_dollars,
  CASE WHEN date < DATE '{DATE_CUT}' THEN 'source' ELSE 'target' END AS domain FROM daily""")
def m02_domain_split(spark, sf_dir):
    """Source / target domains by a date cut."""
    return dm.split_domains(daily_totals(spark, sf_dir), date_cut=DATE_CUT)


@register("m03_domain_discovery")
def m03_domain_discovery(spark, sf_dir):
    """KMeans domains of quarterly store profiles."""
    return dm.discover_domains(_sd(spark, sf_dir), SHIFT_FEATURES, k=4)


@register("m03_domains_over_time")
def m03_domains_over_time(spark, sf_dir):
    """KMeans domains per quarter whose labels follow the clusters from one
    quarter to the next; stores that moved, per quarter."""
    return dm.domain_transitions(dm.domains_over_time(_sd(spark, sf_dir), SHIFT_FEATURES, k=4))


@register("m03_domain_transitions", sql=with_ctes(DAILY_SQL, """per AS (
  SELECT store, CAST(date_trunc('quarter', date) AS DATE) AS period, AVG(sale_dollars) AS v FROM daily GROUP BY 1, 2)""",
    """lev AS (SELECT store, p.period, CAST(CASE WHEN v > 1.25 * m THEN 2 WHEN v > 0.75 * m THEN 1 ELSE 0 END AS INTEGER) AS domain
  FROM per p JOIN (SELECT period, AVG(v) AS m FROM per GROUP BY 1) q ON q.period = p.period)""",
    """mv AS (SELECT *, LAG(domain) OVER (PARTITION BY store ORDER BY period) AS from_domain FROM lev)""")
    + """SELECT period, from_domain, domain AS to_domain, COUNT(*) AS stores FROM mv WHERE from_domain IS NOT NULL GROUP BY 1, 2, 3""")
def m03_domain_transitions(spark, sf_dir):
    """Stores that move between sales levels (below, around and above the
    quarter's mean store) from quarter to quarter."""
    per = (daily_totals(spark, sf_dir).groupBy("store", F.date_trunc("quarter", "date").cast("date").alias("period"))
           .agg(F.avg("sale_dollars").alias("v")))
    per = cut_lineage(per)
    mean = per.groupBy("period").agg(F.avg("v").alias("m"))
    v, m = F.col("v"), F.col("m")
    level = F.when(v > 1.25 * m, 2).when(v > 0.75 * m, 1).otherwise(0)
    return dm.domain_transitions(per.join(mean, "period").select("store", "period", level.alias("domain")))


# Example basket conditions on the temporal features.
BASKET_CONDITIONS = {
    "weekend": "weekday(date) >= 5",
    "below_7d_mean": "sale_dollars_decrease_7d_avg = 1",
    "below_30d_mean": "sale_dollars_decrease_30d_avg = 1",
    "significant_drop": "sale_dollars_significant_decrease = 1",
    "two_drops": "consecutive_decrease = 1",
    "first_purchase_in_week": "days_since_last_purchase > 7",
}


@register("m04_rule_mining")
def m04_rule_mining(spark, sf_dir):
    """FP-growth rules (min support 0.1) over store-day condition baskets."""
    baskets = dm.transaction_items(_tf(spark, sf_dir), BASKET_CONDITIONS, coded=True)
    return dm.mine_rules(baskets, min_support=0.1, min_confidence=0.3, names=list(BASKET_CONDITIONS))


MINED = ["sale_dollars", "sale_dollars_lag_7d", "sale_dollars_rolling_mean_30D", "sale_dollars_rolling_std_30D", "days_since_last_purchase"]


def _mined_items_sql():
    cuts = ", ".join(f"QUANTILE_CONT({c}, [1/3, 2/3]) AS q_{c}" for c in MINED)
    items = ", ".join(f"""CASE WHEN {c} <= q_{c}[1] THEN '{c}:1' WHEN {c} <= q_{c}[2] THEN '{c}:2' WHEN {c} > q_{c}[2] THEN '{c}:3' END""" for c in MINED)
    return TEMPORAL_SQL.rstrip() + f""",
cuts AS (SELECT {cuts} FROM temporal),
bask AS (SELECT row_number() OVER () AS id, [x FOR x IN [{items}] IF x IS NOT NULL] AS items FROM temporal CROSS JOIN cuts),
one AS (SELECT id, UNNEST(items) AS item FROM bask),
n AS (SELECT COUNT(*) AS n FROM bask WHERE len(items) > 0),
sets AS (SELECT item AS items, COUNT(*) AS freq FROM one GROUP BY 1
  UNION ALL SELECT a.item || ' & ' || b.item, COUNT(*) FROM one a JOIN one b ON a.id = b.id AND a.item < b.item GROUP BY 1)
SELECT items, CAST(freq AS BIGINT) AS freq FROM sets, n WHERE freq >= 0.05 * n"""


@register("m04_frequent_items", sql=_mined_items_sql())
def m04_frequent_items(spark, sf_dir):
    """Items and pairs of items in at least 5 % of store-days, the items being
    learned intervals of temporal features (FP-growth)."""
    tf = cut_lineage(_tf(spark, sf_dir).select("store", "date", *MINED))
    conditions = dm.interval_conditions(dm.cut_points(tf, MINED))
    baskets = dm.transaction_items(tf, conditions, coded=True)
    found = dm.frequent_itemsets(baskets, 0.05, list(conditions)).where(F.size("items") <= 2)
    return found.select(F.array_join(F.sort_array("items"), " & ").alias("items"), "freq")


@register("m05_mined_rule_compliance")
def m05_mined_rule_compliance(spark, sf_dir):
    """Rules mined over learned intervals, checked per county."""
    stores = store_attributes(sales(spark, sf_dir)).select("store", "county")
    tf = cut_lineage(_tf(spark, sf_dir).select("store", "date", *MINED).join(stores, "store"))
    return dm.mine_and_check(tf, dm.interval_conditions(dm.cut_points(tf, MINED)), "county", min_support=0.05, min_confidence=0.4)


# Example IF–THEN rules (Spark SQL predicates).
RULES = [
    ("weekend_below_month", "weekday(date) >= 5", "sale_dollars < sale_dollars_rolling_mean_30D"),
    ("drop_below_week", "sale_dollars_decrease_prev = 1", "sale_dollars_decrease_7d_avg = 1"),
    ("near_max_not_below", "sale_dollars >= sale_dollars_rolling_max_30D", "sale_dollars_decrease_30d_avg = 0"),
]
RULES_DUCK = [
    ("weekend_below_month", "isodow(date) >= 6", "sale_dollars < sale_dollars_rolling_mean_30D"),
    ("drop_below_week", "sale_dollars_decrease_prev = 1", "sale_dollars_decrease_7d_avg = 1"),
    ("near_max_not_below", "sale_dollars >= sale_dollars_rolling_max_30D", "sale_dollars_decrease_30d_avg = 0"),
]


def _rules_sql(level="store", source="temporal", ctes=""):
    parts = []
    for rid, a, c in RULES_DUCK:
        A, C = f"COALESCE({a}, FALSE)", f"COALESCE({c}, FALSE)"
        parts.append(f"""SELECT {level}, COUNT(*) AS n_rows, '{rid}' AS rule_id, COUNT(*) FILTER (WHERE {A}) AS n_antecedent,
  COUNT(*) FILTER (WHERE {A} AND {C}) AS n_both, COUNT(*) FILTER (WHERE {A} AND NOT {C}) AS violations FROM {source} GROUP BY {level}""")
    return TEMPORAL_SQL.rstrip() + ctes + f"""
SELECT {level}, n_rows, rule_id, n_antecedent, n_both, violations,
  ROUND(CAST(n_antecedent AS DOUBLE) / n_rows, 9) AS support,
  ROUND(CAST(n_both AS DOUBLE) / NULLIF(n_antecedent, 0), 9) AS confidence FROM (""" + " UNION ALL ".join(parts) + ")"


@register("m05_rule_compliance", sql=_rules_sql())
def m05_rule_compliance(spark, sf_dir):
    """Support, confidence and violations of three rules per store."""
    return dm.rule_compliance(_tf(spark, sf_dir), RULES, "store")


@register("m05_rule_compliance_month", sql=_rules_sql(
    "month", "monthly", """,
monthly AS (SELECT *, CAST(month(date) AS INTEGER) AS month FROM temporal)"""))
def m05_rule_compliance_month(spark, sf_dir):
    """The same rules by calendar month (time level)."""
    return dm.rule_compliance(_tf(spark, sf_dir).withColumn("month", F.month("date")), RULES, "month")


@register("m05_rule_compliance_region", sql=_rules_sql(
    "county", "regional", """,
regional AS (SELECT t.*, s.county FROM temporal t JOIN (
  SELECT store, ARG_MIN(county, date) AS county FROM sales WHERE county IS NOT NULL GROUP BY store) s USING (store))"""))
def m05_rule_compliance_region(spark, sf_dir):
    """The same rules by county (region level), the county of each store
    joined from one row per store."""
    stores = store_attributes(sales(spark, sf_dir)).select("store", "county")
    return dm.rule_compliance(_tf(spark, sf_dir).join(stores, "store"), RULES, "county")


WEIGHTS = [0.5, 0.3, 0.2]


@register("m06_temporal_smoothing", sql=with_ctes(DAILY_SQL) + """SELECT store, date, ROUND(sale_dollars, 9) AS sale_dollars,
  ROUND((0.5 * sale_dollars + COALESCE(0.3 * LAG(sale_dollars, 1) OVER w, 0) + COALESCE(0.2 * LAG(sale_dollars, 2) OVER w, 0))
    / (0.5 + CASE WHEN LAG(sale_dollars, 1) OVER w IS NULL THEN 0 ELSE 0.3 END
            + CASE WHEN LAG(sale_dollars, 2) OVER w IS NULL THEN 0 ELSE 0.2 END), 9) AS sale_dollars_smoothed
FROM daily WINDOW w AS (PARTITION BY store ORDER BY date)""")
def m06_temporal_smoothing(spark, sf_dir):
    """Weighted smoothing (0.5, 0.3, 0.2) over the current and two previous
    store-days."""
    return dm.temporal_smoothing(daily_totals(spark, sf_dir), "sale_dollars", WEIGHTS)


def _mmd_sql():
    z = ", ".join(f"({c} - (SELECT AVG({c}) FROM store_day)) / NULLIF((SELECT STDDEV_SAMP({c}) FROM store_day), 0) AS {c}"
                  for c in SHIFT_FEATURES)
    dist = " + ".join(f"POW(AVG({c}) FILTER (WHERE domain = 'source') - AVG({c}) FILTER (WHERE domain = 'target'), 2)"
                      for c in SHIFT_FEATURES)
    return with_ctes(store_day_cte(), f"""zz AS (SELECT CASE WHEN date < DATE '{DATE_CUT}' THEN 'source' ELSE 'target' END AS domain,
  {z} FROM store_day)""") + f"SELECT ROUND({dist}, 9) AS mmd FROM zz"


@register("m07_mmd_shift", sql=_mmd_sql())
def m07_mmd_shift(spark, sf_dir):
    """Linear-kernel MMD between the source and target periods of
    standardised store-day features."""
    d = dm.split_domains(_sd(spark, sf_dir), date_cut=DATE_CUT)
    return dm.mmd_linear(d, SHIFT_FEATURES)


@register("m07_a_distance")
def m07_a_distance(spark, sf_dir):
    """Proxy A-distance of a logistic domain classifier (source vs target)."""
    d = dm.split_domains(_sd(spark, sf_dir), date_cut=DATE_CUT)
    return dm.a_distance(d, SHIFT_FEATURES)


@register("m08_prediction_fusion", sql=TEMPORAL_SQL.rstrip() + """,
preds AS (
  SELECT store, date, sale_dollars, 'short' AS domain, sale_dollars_rolling_mean_7D AS y_hat FROM temporal
  UNION ALL SELECT store, date, sale_dollars, 'long' AS domain, sale_dollars_rolling_mean_30D AS y_hat FROM temporal),
wts AS (SELECT domain, 1.0 / (1.0 + AVG(ABS(sale_dollars - y_hat))) AS weight FROM preds GROUP BY domain)
SELECT store, date, ROUND(SUM(y_hat * weight) / SUM(weight), 9) AS y_hat_fused, COUNT(*) AS n_domains
FROM preds JOIN wts USING (domain) GROUP BY store, date""")
def m08_prediction_fusion(spark, sf_dir):
    """Two per-domain predictors (7-day and 30-day means) fused with
    weights 1/(1 + MAE) measured on the data."""
    tf = _tf(spark, sf_dir)
    columns = ["sale_dollars_rolling_mean_7D", "sale_dollars_rolling_mean_30D"]
    errors = tf.agg(*[F.avg(F.abs(F.col("sale_dollars") - F.col(c))).alias(c) for c in columns]).first()
    fused = dm.fuse_columns(tf, {c: 1.0 / (1.0 + errors[c]) for c in columns})
    return fused.select("store", "date", "y_hat_fused", F.lit(len(columns)).cast("long").alias("n_domains"))


@register("m08_domain_fusion", sql=TEMPORAL_SQL.rstrip() + """,
dom AS (SELECT t.store, t.date, t.sale_dollars, t.sale_dollars_rolling_mean_30D AS x, t.sale_dollars_rolling_std_30D AS sd, s.county AS domain
  FROM temporal t JOIN (SELECT store, ARG_MIN(county, date) AS county FROM sales WHERE county IS NOT NULL GROUP BY store) s USING (store)),
fit AS (SELECT domain AS source, REGR_SLOPE(sale_dollars, x) AS b, REGR_INTERCEPT(sale_dollars, x) AS a FROM dom GROUP BY domain),
st AS (SELECT AVG(sale_dollars) AS m1, STDDEV_SAMP(sale_dollars) AS s1, AVG(x) AS m2, STDDEV_SAMP(x) AS s2, AVG(sd) AS m3, STDDEV_SAMP(sd) AS s3 FROM dom),
zz AS (SELECT domain, AVG((sale_dollars - m1) / NULLIF(s1, 0)) AS z1, AVG((x - m2) / NULLIF(s2, 0)) AS z2, AVG((sd - m3) / NULLIF(s3, 0)) AS z3 FROM dom, st GROUP BY domain),
sim AS (SELECT p.domain, q.domain AS source, EXP(-(COALESCE(POW(p.z1 - q.z1, 2), 0) + COALESCE(POW(p.z2 - q.z2, 2), 0) + COALESCE(POW(p.z3 - q.z3, 2), 0))) AS weight
  FROM zz p CROSS JOIN zz q)
SELECT store, date, ROUND(SUM((a + b * x) * weight) / SUM(weight), 9) AS y_hat_fused, COUNT(*) AS n_domains
FROM dom JOIN sim USING (domain) JOIN fit USING (source) WHERE x IS NOT NULL AND b IS NOT NULL GROUP BY store, date""")
def m08_domain_fusion(spark, sf_dir):
    """Next to its own domain's regressor (county), every store-day is
    predicted by those of all domains, weighted by exp(−MMD) between them."""
    features = ["sale_dollars", "sale_dollars_rolling_mean_30D", "sale_dollars_rolling_std_30D"]
    stores = store_attributes(sales(spark, sf_dir)).select("store", F.col("county").alias("domain"))
    tf = cut_lineage(_tf(spark, sf_dir).select("store", "date", *features).join(stores, "store"))
    fitted = dm.domain_regressors(tf, "sale_dollars", features[1])
    preds = dm.source_predictions(tf, fitted, features[1], ["store", "date"])
    return dm.fuse_predictions(preds, F.broadcast(dm.domain_similarities(tf, features)),  # pairs of counties
                               ["store", "date"], ["domain", "source"])


@register("m09_early_warning", sql=TEMPORAL_SQL + """SELECT tp, fp, fn, tn,
  ROUND(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 9) AS accuracy,
  ROUND(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 9) AS precision,
  ROUND(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 9) AS recall,
  ROUND(CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0), 9) AS false_alarm_rate FROM (
  SELECT COUNT(*) FILTER (WHERE p = 1 AND a = 1) AS tp, COUNT(*) FILTER (WHERE p = 1 AND a = 0) AS fp,
         COUNT(*) FILTER (WHERE p = 0 AND a = 1) AS fn, COUNT(*) FILTER (WHERE p = 0 AND a = 0) AS tn
  FROM (SELECT sale_dollars_significant_decrease AS p,
    CAST(LEAD(sale_dollars) OVER (PARTITION BY store ORDER BY date) < 0.9 * sale_dollars_rolling_mean_30D AS INTEGER) AS a
    FROM temporal) WHERE a IS NOT NULL)""")
def m09_early_warning(spark, sf_dir):
    """Significant-decrease flag against the realised next purchase below
    90 % of the 30-day mean: confusion counts and rates."""
    tf = _tf(spark, sf_dir)
    w = Window.partitionBy("store").orderBy("date")
    actual = (F.lead("sale_dollars").over(w) < F.lit(0.9) * F.col("sale_dollars_rolling_mean_30D")).cast("int")
    return dm.early_warning(tf.withColumn("actual_decline", actual),
                            "sale_dollars_significant_decrease", "actual_decline")
