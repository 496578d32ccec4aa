"""Store-day aggregation (I1) and the grouped totals of the profiling
notebooks (D13–D18, D33).

Scale notes
-----------
* Store-days of up to ``BUFFER_LINES`` lines, all but a few, are aggregated by
  one exchange: lines are dealt and sorted by store-day and its run of lines
  is measured once, medians, distinct counts and item records included
  (``runs``).  Three aggregates of their own (moments, medians, distinct
  counts) were measured about four times slower on these.
* ``store_day_series`` deals lines by store, so that its store-days come in
  series and what follows in the task (frames, fills) moves nothing.
* Larger store-days are found by a count and never held: declarative moments
  in a hash aggregate with map-side partial aggregation, distinct counts by
  Spark's shuffle on (keys, value), medians by value counts ranked in a
  spillable window.
* Store attributes come from one row per distinct combination of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from ..functions.aggs import AGG_FUNCS, first_non_null, pd_median, pd_nunique, pd_sum
from ..functions.scalar import geo_lat, geo_lon, safe_div, weekday_name
from .runs import measure_runs

# The store-day aggregate list, in the reference's order.
STORE_DAY_AGGS = [
    ("sale_bottles", ["sum", "mean", "median", "std", "min", "max", "skew", "sem"]),
    ("sale_dollars", ["sum", "mean", "median", "std", "min", "max", "skew", "sem"]),
    ("sale_liters", ["sum", "mean", "median", "std", "min", "max", "skew", "sem"]),
    ("sale_gallons", ["sum", "mean", "median", "std", "min", "max"]),
    ("invoice_line_no", ["count", "nunique"]),
    ("state_bottle_cost", ["mean", "median", "std", "min", "max"]),
    ("state_bottle_retail", ["mean", "median", "std", "min", "max"]),
    ("category", ["nunique", "count"]),
    ("category_name", ["nunique", "count"]),
    ("itemno", ["nunique", "count"]),
    ("pack", ["mean", "median", "std", "min", "max", "sum"]),
    ("bottle_volume_ml", ["mean", "median", "std", "min", "max", "sum"]),
]

# Renamed aggregate columns.
STORE_DAY_RENAMES = {
    "invoice_line_no_count": "transaction_count",
    "invoice_line_no_nunique": "unique_transactions",
    "category_nunique": "unique_categories",
    "category_name_nunique": "unique_category_names",
    "itemno_nunique": "unique_items",
    "sale_dollars_sum": "sale_dollars",
    "sale_bottles_sum": "sale_bottles",
    "sale_liters_sum": "sale_liters",
    "sale_gallons_sum": "sale_gallons",
}

STORE_ATTRIBUTES = ["name", "address", "city", "zipcode", "store_location", "county"]

# The fields of one item record in ``item_details``.
ITEM_DETAIL_FIELDS = ["category_name", "im_desc", "pack", "bottle_volume_ml",
                      "state_bottle_cost", "state_bottle_retail", "sale_dollars",
                      "sale_bottles", "sale_liters", "sale_gallons"]

KEYS = ["store", "date"]


def agg_name(column: str, agg: str) -> str:
    name = f"{column}_{agg}"
    return STORE_DAY_RENAMES.get(name, name)


def valid_lines(sales: DataFrame) -> DataFrame:
    """Drop lines without a store or date (pandas drops NULL group keys)."""
    return sales.where(F.col("store").isNotNull() & F.col("date").isNotNull())


def _store_day_exprs(exact_median: bool):
    """(declarative moments, medians, distinct counts) of the 60 aggregates."""
    plain, medians, distinct = [], [], []
    for column, aggs in STORE_DAY_AGGS:
        for agg in aggs:
            if agg == "nunique":
                distinct.append(pd_nunique(column).alias(agg_name(column, agg)))
            elif agg == "median":
                medians.append(pd_median(column, exact=exact_median).alias(agg_name(column, agg)))
            else:
                plain.append(AGG_FUNCS[agg](column).alias(agg_name(column, agg)))
    return plain, medians, distinct


# A store-day with more lines than this is never held in one list.
BUFFER_LINES = 10_000


def _from_lists(lines: DataFrame, with_items: bool) -> DataFrame:
    """The 60 aggregates of store-days of few lines, from one list of lines
    each (for columns that ``_from_runs`` does not take): sorted arrays give least, greatest and middle values, sums are
    folds, and the central moments are taken about the mean."""
    types = {f.name: f.dataType for f in lines.schema.fields}
    aggs = dict(STORE_DAY_AGGS)
    numeric = [c for c, fs in STORE_DAY_AGGS if "mean" in fs]
    other = [c for c in aggs if c not in numeric]
    items = [item_details_agg()] if with_items else []
    out = lines.groupBy(*KEYS).agg(F.collect_list(F.struct(*numeric, *other)).alias("_v"), *items)

    def values(c):
        return F.filter(F.transform("_v", lambda r: r[c]), lambda x: x.isNotNull())
    out = out.withColumns({f"_a_{c}": F.sort_array(values(c).cast("array<double>")) for c in numeric}
                          | {f"_a_{c}": values(c) for c in other}).drop("_v")
    out = out.withColumns({f"_s_{c}": F.aggregate(f"_a_{c}", F.lit(0.0), lambda s, x: s + x) for c in numeric})
    out = out.withColumns({f"_m_{c}": F.try_divide(F.col(f"_s_{c}"), F.size(f"_a_{c}").cast("double")) for c in numeric})

    def power(c, k):
        def add(s, x):
            d = x - F.col(f"_m_{c}")
            return s + (d * d if k == 2 else d * d * d)
        # A constant group has no moments, whatever the rounding of its mean.
        constant = F.get(f"_a_{c}", F.lit(0)) == F.element_at(f"_a_{c}", -1)
        return F.when(constant, F.lit(0.0)).otherwise(F.aggregate(f"_a_{c}", F.lit(0.0), add))
    full = out.withColumns({f"_2_{c}": F.when(F.size(f"_a_{c}") > 1, power(c, 2)) for c in numeric if "std" in aggs[c]}
                           | {f"_3_{c}": F.when(F.size(f"_a_{c}") > 2, power(c, 3)) for c in numeric if "skew" in aggs[c]})
    result = []
    for c, fs in STORE_DAY_AGGS:
        a, n = F.col(f"_a_{c}"), F.size(f"_a_{c}")
        m2, d = F.col(f"_2_{c}") if "std" in fs else None, n.cast("double")
        whole = isinstance(types[c], IntegralType)
        made = {
            "count": lambda: n.cast("long"),
            "nunique": lambda: F.size(F.array_distinct(a)).cast("long"),
            "sum": lambda: F.col(f"_s_{c}").cast("long" if whole else "double"),
            "mean": lambda: F.col(f"_m_{c}"),
            "min": lambda: F.get(a, F.lit(0)).cast(types[c]),
            "max": lambda: F.get(a, n - 1).cast(types[c]),
            "median": lambda: _middle(a, n),
            "std": lambda: F.sqrt(m2 / (d - 1)),
            "sem": lambda: F.sqrt(m2 / (d - 1)) / F.sqrt(d),
            "skew": lambda: F.when(n >= 3, F.when(m2 == 0, F.lit(0.0)).otherwise(
                F.col(f"_3_{c}") / d / F.pow(m2 / d, 1.5) * F.sqrt(d * (d - 1)) / (d - 2))),
        }
        result += [made[f]().alias(agg_name(c, f)) for f in fs]
    return full.select(*KEYS, *result, *(["item_details"] if with_items else []))


def _plain_numbers(lines: DataFrame) -> bool:
    """Whether the measured columns are numbers that tasks turn into doubles."""
    types = {f.name: f.dataType for f in lines.schema.fields}
    return all(isinstance(types[c], (IntegralType, DoubleType, FloatType)) for c, fs in STORE_DAY_AGGS if "mean" in fs)


def _from_runs(lines: DataFrame, with_items: bool = False, aggs: list | None = None, deal: list[str] | None = None) -> DataFrame:
    """The 60 aggregates (or some of them, ``aggs``) of store-days of few lines
    without lists: lines are dealt (by ``deal``, the keys by default) and sorted
    by store-day, each run of them is measured once, and the aggregates are
    formulas over its counts, sums, least, greatest and middle values and
    central sums.  The rows of a task come in the order of the keys."""
    aggs = aggs or STORE_DAY_AGGS
    types = {f.name: f.dataType for f in lines.schema.fields}
    measured = [c for c, fs in STORE_DAY_AGGS if "mean" in fs]
    powers = {c: 3 if "skew" in fs else 2 if {"std", "sem"} & set(fs) else 1 for c, fs in aggs if c in measured}
    other = [c for c, _ in aggs if c not in powers]
    records = ITEM_DETAIL_FIELDS if with_items else []
    plain = _plain_numbers(lines)
    rows = lines.select(*KEYS, *[F.col(c) if plain else F.col(c).cast("double").alias(c) for c in powers],
                        *[F.when(F.col(c).isNotNull(), F.lit(True)).alias(c) if fs == ["count"] else F.col(c) for c, fs in aggs if c in other],
                        *[c for c in records if c not in powers and c not in other])
    out = []
    for c, fs in aggs:
        n, m2, m3 = F.col(f"_n_{c}"), F.col(f"_m2_{c}"), F.col(f"_m3_{c}")
        d = n.cast("double")
        whole = isinstance(types[c], IntegralType)
        made = {
            "count": lambda: n,
            "nunique": lambda: F.col(f"_d_{c}"),
            "sum": lambda: F.col(f"_s_{c}").cast("long" if whole else "double"),
            "mean": lambda: F.try_divide(F.col(f"_s_{c}"), d),
            "min": lambda: F.col(f"_a_{c}").cast(types[c]),
            "max": lambda: F.col(f"_z_{c}").cast(types[c]),
            "median": lambda: F.col(f"_mid_{c}"),
            "std": lambda: F.sqrt(m2 / (d - 1)),
            "sem": lambda: F.sqrt(m2 / (d - 1)) / F.sqrt(d),
            "skew": lambda: F.when(n >= 3, F.when(m2 == 0, F.lit(0.0)).otherwise(
                m3 / d / F.pow(m2 / d, 1.5) * F.sqrt(d * (d - 1)) / (d - 2))),
        }
        out += [made[f]().alias(agg_name(c, f)) for f in fs]
    items = [F.col("_records").alias("item_details")] if with_items else []
    return measure_runs(rows, KEYS, powers, other, records=records, deal=deal).select(*KEYS, *out, *items)


def _middle(a, n):
    """The median of a sorted array, in the form ``percentile`` interpolates."""
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.ceil((n - 1) / 2).cast("int"))
    return F.when(low == high, low).otherwise(F.lit(0.5) * low + F.lit(0.5) * high)


def _separate(lines: DataFrame, exact_median: bool, median_method: str) -> DataFrame:
    """The 60 aggregates by three aggregates on the same keys: declarative
    moments, medians and distinct counts, each with its own partial step."""
    from .quantile import grouped_quantile_columns
    plain, medians, distinct = _store_day_exprs(exact_median)
    out = lines.groupBy(*KEYS).agg(*plain).join(lines.groupBy(*KEYS).agg(*distinct), KEYS, "inner")
    if not exact_median or median_method == "percentile":
        return out.join(lines.groupBy(*KEYS).agg(*medians), KEYS, "inner")
    columns = [c for c, aggs in STORE_DAY_AGGS if "median" in aggs]
    return out.join(grouped_quantile_columns(lines, KEYS, columns, 0.5, [agg_name(c, "median") for c in columns]), KEYS, "left")


def store_day_aggregates(sales: DataFrame, exact_median: bool = True, median_method: str = "bounded",
                         buffer_lines: int = BUFFER_LINES, with_items: bool = False) -> DataFrame:
    """The 60 store-day aggregates (D3–D12), one row per (store, date).

    ``median_method``: 'bounded' (store-days of up to ``buffer_lines`` lines
    from lists, larger ones without holding them), 'rank' (nothing held, for
    every group) or 'percentile' (value buffers for every group);
    ``exact_median=False`` uses a bounded sketch.  ``with_items`` adds
    ``item_details`` (D2)."""
    from ..session import split_wide_code
    split_wide_code(sales.sparkSession)
    lines = valid_lines(sales)
    names = [*KEYS, *[agg_name(c, a) for c, aggs in STORE_DAY_AGGS for a in aggs], *(["item_details"] if with_items else [])]

    def separate(some: DataFrame, method: str) -> DataFrame:
        out = _separate(some, exact_median, method)
        return out.join(item_details(some), KEYS, "left") if with_items else out
    if not exact_median or median_method != "bounded":
        return separate(lines, median_method).select(names)
    few = (lambda some: _from_lists(some, True)) if with_items and not _plain_numbers(lines) else lambda some: _from_runs(some, with_items)
    return _by_size(lines, buffer_lines, lambda some: few(some).select(names),
                    lambda some: separate(some, "rank").select(names))


def few_lines_a_day(lines: DataFrame, buffer_lines: int = BUFFER_LINES) -> bool:
    """Whether no store-day has more lines than a task is to hold; the lines
    of whole stores, which need no exchange to speak of, mostly tell."""
    if (lines.groupBy("store").count().agg(F.max("count")).first()[0] or 0) <= buffer_lines:
        return True
    return lines.groupBy(*KEYS).count().where(F.col("count") > buffer_lines).isEmpty()


def _by_size(lines: DataFrame, buffer_lines: int, few, many) -> DataFrame:
    """``few`` of the lines of store-days of up to ``buffer_lines`` lines, and
    ``many`` of the others, which are found by a count."""
    from ..session import cut_lineage
    large = cut_lineage(lines.groupBy(*KEYS).count().where(F.col("count") > buffer_lines).select(*KEYS))
    if large.isEmpty():
        return few(lines)
    return few(lines.join(large, KEYS, "left_anti")).unionByName(many(lines.join(large, KEYS, "left_semi")))


def item_details_agg():
    """Distinct item records of a group as a sorted array of structs.
    The set buffer is deduplicated map-side; the array holds the distinct
    records of one store-day, which is the requested output."""
    rec = F.struct(*[F.col(c) for c in ITEM_DETAIL_FIELDS])
    return F.array_sort(F.collect_set(rec)).alias("item_details")


def item_details(sales: DataFrame) -> DataFrame:
    return valid_lines(sales).groupBy(*KEYS).agg(item_details_agg())


def line_columns(sales: DataFrame) -> list[str]:
    """The columns of the lines that the store-day table is made from."""
    wanted = [*KEYS, *STORE_ATTRIBUTES, *ITEM_DETAIL_FIELDS, *[c for c, _ in STORE_DAY_AGGS]]
    return [c for c in sales.columns if c in wanted]


def prepared_lines(sales: DataFrame) -> DataFrame:
    """Valid lines with the needed columns, written once: the aggregates
    that follow scan that table instead of repeating the source's joins."""
    from ..session import cut_lineage
    return cut_lineage(valid_lines(sales).select(*line_columns(sales)))


def store_attributes(sales: DataFrame) -> DataFrame:
    """One row per store with the first non-NULL value of each attribute
    by date (of values first seen on one day, the smallest).  Lines shrink
    to one row per distinct combination in a code-generated hash aggregate;
    only those few rows reach the ``min_by`` per attribute."""
    seen = (valid_lines(sales).groupBy("store", *STORE_ATTRIBUTES).agg(F.min("date").alias("_since")))
    return seen.groupBy("store").agg(*[first_non_null(c, "_since").alias(c) for c in STORE_ATTRIBUTES])


def store_day_some(sales: DataFrame, names: list[str], buffer_lines: int = BUFFER_LINES) -> DataFrame:
    """Only the named store-day aggregates (no medians): for queries that
    read a few columns of the store-day table.  Distinct counts alone take
    the runs of store-days of few lines: ``count(DISTINCT)`` of several
    columns moves every line once a column."""
    pairs = [(c, a) for c, aggs in STORE_DAY_AGGS for a in aggs if agg_name(c, a) in names and a != "median"]

    from ..session import cut_lineage

    def some(lines: DataFrame) -> DataFrame:
        return lines.groupBy(*KEYS).agg(*[AGG_FUNCS[a](c).alias(agg_name(c, a)) for c, a in pairs])
    lines = valid_lines(sales)
    if len(pairs) < 2 or {a for _, a in pairs} != {"nunique"}:
        return some(lines)
    columns = [c for c, _ in pairs]
    # Lines of large store-days come back beside the counts of the others.
    runs = cut_lineage(measure_runs(lines, KEYS, {}, columns, pass_above=buffer_lines))
    counted = [F.col(f"_d_{c}").alias(agg_name(c, "nunique")) for c in columns]
    few, many = runs.where("_whole").select(*KEYS, *counted), runs.where("not _whole")
    return few if many.isEmpty() else few.unionByName(some(many))


def store_day(sales: DataFrame, *, exact_median: bool = True,
              with_item_details: bool = True, fill_medians: bool = True,
              materialize: bool = False, median_method: str = "bounded") -> DataFrame:
    """Invoice lines → one row per (store, date).

    Columns: keys, the six store attributes (first non-NULL per store in date
    order), ``lon``/``lat``, optionally ``item_details``, 60 aggregates and
    three ratios whose zero-denominator NULLs are filled with the global
    median (a lazy scalar subquery, no join).  With ``materialize`` the
    table is checkpointed before the fill, so the median subquery reads the
    checkpoint instead of re-running the aggregation.
    """
    sd = store_day_aggregates(sales, exact_median=exact_median, median_method=median_method, with_items=with_item_details)
    # Coordinates are parsed once per store; the written table's size is known,
    # so Spark broadcasts it when it is small and the store-days stay put.
    attributes = store_attributes(sales).withColumns({"lon": geo_lon("store_location"), "lat": geo_lat("store_location")})
    if materialize:
        from ..session import cut_lineage
        attributes = cut_lineage(attributes)
    sd = _with_attributes(sd, attributes, with_item_details)
    if materialize:
        sd = cut_lineage(sd)
    if fill_medians:
        sd = fill_with_median(sd, RATIO_COLUMNS)
    return sd


RATIO_COLUMNS = ["avg_price_per_bottle", "avg_price_per_liter", "avg_items_per_transaction"]


def _ratios(sd: DataFrame) -> DataFrame:
    return sd.withColumns({
        "avg_price_per_bottle": safe_div("sale_dollars", "sale_bottles"),
        "avg_price_per_liter": safe_div("sale_dollars", "sale_liters"),
        "avg_items_per_transaction": safe_div("unique_items", "transaction_count"),
    })


def _with_attributes(sd: DataFrame, attributes: DataFrame, with_item_details: bool) -> DataFrame:
    """Store-day aggregates with the attributes of their stores and the ratios."""
    agg_cols = [agg_name(c, a) for c, aggs in STORE_DAY_AGGS for a in aggs]
    extra = ["item_details"] if with_item_details else []
    return _ratios(sd.join(attributes, "store").select(*KEYS, *STORE_ATTRIBUTES, *extra, *agg_cols, "lon", "lat"))


class StoreDays(NamedTuple):
    """The store-day table.  ``stats``: a written table of the few columns of it
    that global medians, store profiles and the calendar read; None where
    ``rows`` is written itself.  ``dealt``: rows come dealt by store and in
    order of dates, without a write or an exchange since the lines."""

    rows: DataFrame
    stats: DataFrame | None
    dealt: bool


#: What ``stats`` is made of.
STATS_AGGS = [("sale_bottles", ["sum"]), ("sale_dollars", ["sum"]), ("sale_liters", ["sum"]), ("invoice_line_no", ["count"]),
              ("state_bottle_cost", ["mean"]), ("state_bottle_retail", ["mean"]), ("itemno", ["nunique"])]
# A store of more lines is not dealt to one task, nor are attributes of more
# stores broadcast.
SERIES_LINES, SERIES_STORES = 1_000_000, 500_000


def store_day_series(lines: DataFrame, *, with_item_details: bool = True, fill_medians: bool = True,
                     exact_median: bool = True, buffer_lines: int = BUFFER_LINES, series_lines: int = SERIES_LINES,
                     series_stores: int = SERIES_STORES, written_items: bool | None = None) -> StoreDays:
    """I1 for what goes on per store: lines (written) are dealt by store and
    sorted by date once, and the wide store-day rows come in series, neither
    written nor moved again.  Global statistics come from a narrow table, made
    from the lines by an exchange of its own.  Stores or store-days of too
    many lines for one task, or too many stores to broadcast, take the written
    table of ``store_day`` (with item records if ``written_items``)."""
    from ..session import cut_lineage, split_wide_code
    split_wide_code(lines.sparkSession)
    lines = valid_lines(lines)
    many = lines.groupBy("store").count().agg(F.max("count"), F.count(F.lit(1))).first()
    fits = exact_median and _plain_numbers(lines) and (many[0] or 0) <= series_lines and many[1] <= series_stores
    if not fits or (many[0] or 0) > buffer_lines and not few_lines_a_day(lines, buffer_lines):
        items = with_item_details if written_items is None else written_items
        return StoreDays(store_day(lines, exact_median=exact_median, with_item_details=items, fill_medians=fill_medians, materialize=True), None, False)
    attributes = F.broadcast(cut_lineage(store_attributes(lines).withColumns(
        {"lon": geo_lon("store_location"), "lat": geo_lat("store_location")})))
    stats = _from_runs(lines, aggs=STATS_AGGS).join(attributes.select("store", "city", "county"), "store")
    stats = cut_lineage(_ratios(stats), "zstd")
    rows = _with_attributes(_from_runs(lines, with_item_details, deal=["store"]), attributes, with_item_details)
    if fill_medians:
        rows, stats = fill_with_median(rows, RATIO_COLUMNS, stats), fill_with_median(stats, RATIO_COLUMNS, stats)
    return StoreDays(rows, stats, True)


def fill_with_median(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Replace NULLs by the column's global median.

    The medians are exact and distributed (``exact_quantiles``: no task
    merges a column's distinct values); they enter the plan as literals, so
    later actions on the result do not re-run them.  ``stats``: a written
    table of the same rows that has the columns.
    """
    from .quantile import exact_quantiles
    meds = exact_quantiles(df if stats is None else stats, {c: [0.5] for c in columns}, written=stats is not None)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(meds[c][0]).cast("double")) for c in columns})


# ---------------------------------------------------------------------------
# Grouped totals used by the profiling notebooks
# ---------------------------------------------------------------------------

def monthly_totals(sales: DataFrame, value: str = "sale_dollars") -> DataFrame:
    """Totals by (year, month) with the first-of-month date."""
    return (sales.groupBy(F.year("date").alias("year"), F.month("date").alias("month"))
            .agg(pd_sum(value).alias(f"total_{value}"))
            .withColumn("month_start", F.make_date("year", "month", F.lit(1))))


# Weekday names in Monday-first order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_dimension(spark) -> DataFrame:
    """The 7-row Monday…Sunday dimension with its position."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(WEEKDAYS)],
                                 "weekday_pos int, weekday string")


def weekday_totals(sales: DataFrame, value: str = "sale_dollars") -> DataFrame:
    """D14 + C7: totals by weekday name over the fixed Monday…Sunday
    domain; a weekday without sales gives NULL (``reindex``)."""
    totals = (sales.groupBy(weekday_name("date").alias("weekday"))
              .agg(F.sum(value).alias(f"total_{value}")))
    dim = F.broadcast(weekday_dimension(sales.sparkSession))  # fixed 7 rows
    return dim.join(totals, "weekday", "left").orderBy("weekday_pos")


def totals_by(sales: DataFrame, key: str, value: str = "sale_dollars") -> DataFrame:
    """Totals by one key, largest first (key breaks ties)."""
    return (sales.groupBy(key).agg(pd_sum(value).alias(f"total_{value}"))
            .orderBy(F.desc(f"total_{value}"), F.asc(key)))


def top_k(sales: DataFrame, key: str, k: int = 10, value: str = "sale_dollars") -> DataFrame:
    """the k largest totals (planned as TakeOrderedAndProject: each task
    keeps k rows, the driver merges k × tasks rows)."""
    return totals_by(sales, key, value).limit(k)


def item_day(sales: DataFrame) -> DataFrame:
    """(store, itemno, date) roll-up with first pack and volume and the
    bottle total."""
    return (valid_lines(sales).groupBy("store", "itemno", "date")
            .agg(first_non_null("pack", "invoice_line_no").alias("pack"),
                 first_non_null("bottle_volume_ml", "invoice_line_no").alias("bottle_volume_ml"),
                 pd_sum("sale_bottles").alias("sale_bottles")))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Frequency table, most frequent first."""
    return df.groupBy(key).count().orderBy(F.desc("count"), F.asc(key))


def top1_by_frequency(df: DataFrame, key: str) -> DataFrame:
    """the single most frequent key value (tie → smallest key; pandas
    takes the first seen, which has no meaning on a distributed table)."""
    return value_counts(df, key).limit(1).select(key)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """D33 / G2."""
    return df.select(*columns).distinct()
