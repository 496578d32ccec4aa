"""Profiling and association statistics (I10; D20–D29, M10, M11).

Matrices are produced in long form ``(col_a, col_b, value)``: their size is
the number of column pairs, never the data.  Contingency tables stay long
``(a, b, n)`` — category × item tables are never pivoted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import cut_lineage
from .clean import null_report  # noqa: F401  (D20 lives with the cleaning code)

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


#: Rows of a group table up to which it is broadcast to the rows of its groups.
BROADCAST_ROWS = 100_000


def join_small(df: DataFrame, groups: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a written table of one row per group to rows of its groups: by
    broadcast if it counts at most ``limit`` rows, so that few hot keys do
    not gather all rows in few tasks; else by a plain join, where the keys
    are many and adaptive execution splits hot ones.  Same result."""
    small = groups.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(groups) if small else groups, key, how)


def numeric_columns(df: DataFrame) -> list[str]:
    """B2: the numeric columns (``select_dtypes(include=number)``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def shape_profile(df: DataFrame) -> DataFrame:
    """Per column its type, non-NULL count and the row count."""
    counts = df.select(F.count(F.lit(1)).alias("_rows"),
                       *[F.count(F.col(c)).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', '{t}', `{c}`" for c, t in df.dtypes)
    return counts.selectExpr("_rows AS row_count",
                             f"stack({len(df.columns)}, {stack}) AS (column, dtype, non_null)")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles (linear), max per numeric
    column — one aggregate pass for the moments, the quartiles from
    ``exact_quantiles`` (literals), unpivoted to one row per column."""
    from .quantile import exact_quantiles
    cols = columns or numeric_columns(df)
    qs = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        q = [F.lit(v).cast("double") for v in qs[c]]
        aggs.append(F.struct(F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                             q[0].alias("q25"), q[1].alias("q50"),
                             q[2].alias("q75"), F.max(x).alias("max")).alias(c))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, s)")
                .select("column", "s.*"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None,
                       chunk: int = 10, written: bool = False) -> DataFrame:
    """Pearson correlation of every column pair, NULLs skipped pairwise.
    Long form with both orders and the diagonal.  Pairs are evaluated in
    chunks of ``chunk`` ``corr`` expressions per aggregate: a wider aggregate
    generates methods too large for the JIT and runs ~3× slower than the
    extra passes cost; they read a written table of these columns
    (``written``: ``df`` is one)."""
    cols = columns or numeric_columns(df)
    if not written:
        df = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    pairs = list(combinations_with_replacement(cols, 2))
    parts = []
    for i in range(0, len(pairs), chunk):
        block = pairs[i:i + chunk]
        wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{j}")
                        for j, (a, b) in enumerate(block)])
        stack = ", ".join(f"'{a}', '{b}', p{j}" for j, (a, b) in enumerate(block))
        parts.append(wide.selectExpr(f"stack({len(block)}, {stack}) AS (col_a, col_b, value)"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return _both_orders(long, "value")


def target_correlations(df: DataFrame, target: str, columns: list[str] | None = None,
                        first_rank: int = 2, last_rank: int = 16) -> DataFrame:
    """D24 + F7: correlations with ``target`` ranked descending; ranks
    ``first_rank``…``last_rank`` (rank 1 is the target itself)."""
    cols = columns or numeric_columns(df)
    wide = df.agg(*[F.corr(F.col(target).cast("double"), F.col(c).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, correlation)")
    # A window over one row per feature (bounded by the column count).
    # Correlations equal to 9 digits (e.g. of proportional columns) tie and
    # are ordered by name, so float noise cannot reorder them.
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(F.round("correlation", 9)),
                                              F.asc("feature"))
    ranked = long.withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") >= first_rank) & (F.col("rank") <= last_rank))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table (a, b, n) over rows where both are set."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
              .agg(F.count(F.lit(1)).alias("n")))


def cramers_v_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """D26 for many column pairs in one scan: chi-square and Cramér's V.

    Every row is exploded into one (pair, a, b) record per pair and counted
    with a partial aggregate, so all contingency tables come from a single
    pass (their size is bounded by the distinct value combinations, not by
    the rows).  Per pair, from the long table: χ² = n·(Σ O²/(R·C) − 1).  A
    2×2 table (one degree of freedom) gets Yates' correction: every cell has
    the same |O − E| = |O₁₁ − R₁C₁/n|, so
    χ² = max(|O₁₁ − E₁₁| − ½, 0)² · n · (1/R₁ + 1/R₂)(1/C₁ + 1/C₂).
    V = sqrt(χ² / (n·(min(r, c) − 1))); NULL for a one-level column.
    Values are compared as text, so columns of any type can be paired.
    """
    recs = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                              F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
                     for a, b in pairs])
    ct = (df.select(F.explode(recs).alias("r")).select("r.*")
            .where(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("col_a", "col_b", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    # Marginals are grouped sums joined back: no task holds a whole table.
    ct = cut_lineage(ct)
    pair = ["col_a", "col_b"]
    rows = ct.groupBy(*pair, "a").agg(F.sum("n").alias("R"))
    columns = ct.groupBy(*pair, "b").agg(F.sum("n").alias("C"))
    levels = (rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("r"), F.min_by(F.struct("a", "R"), "a").alias("x"))
              .join(columns.groupBy(*pair).agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("b", "C"), "b").alias("y")), pair))
    levels = levels.select(*pair, "r", "c", F.col("x.a").alias("a1"), F.col("x.R").cast("double").alias("r1"),
                           F.col("y.b").alias("b1"), F.col("y.C").cast("double").alias("c1"))
    sums = (ct.join(rows, [*pair, "a"]).join(columns, [*pair, "b"]).groupBy(*pair).agg(
        F.sum("n").cast("double").alias("n_total"),
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("R").cast("double") * F.col("C"))).alias("s")))
    corner = ct.select(F.col("col_a").alias("_a"), F.col("col_b").alias("_b"), "a", "b", F.col("n").alias("o11"))
    stats = (sums.join(levels, pair)
             .join(corner, (F.col("col_a") == F.col("_a")) & (F.col("col_b") == F.col("_b"))
                   & (F.col("a") == F.col("a1")) & (F.col("b") == F.col("b1")), "left")
             .withColumn("o11", F.coalesce("o11", F.lit(0)).cast("double")))
    nt, r1, c1 = F.col("n_total"), F.col("r1"), F.col("c1")
    yates = (F.pow(F.greatest(F.abs(F.col("o11") - r1 * c1 / nt) - F.lit(0.5), F.lit(0.0)), 2)
             * nt * (F.lit(1.0) / r1 + F.lit(1.0) / (nt - r1)) * (F.lit(1.0) / c1 + F.lit(1.0) / (nt - c1)))
    chi2 = (F.when((F.col("r") == 2) & (F.col("c") == 2), yates)
             .when((F.col("r") >= 2) & (F.col("c") >= 2), nt * (F.col("s") - F.lit(1.0)))
             .otherwise(F.lit(0.0)))
    k = F.least("r", "c") - 1
    return stats.select(
        "col_a", "col_b", chi2.alias("chi2"),
        F.when(k > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (nt * k))).alias("cramers_v"),
        nt.cast("long").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and Cramér's V of two categorical columns."""
    return cramers_v_pairs(df, [(a, b)])


def cramers_v_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Symmetric matrix (long form) over a column list; the upper
    triangle and the diagonal come from one scan, the lower is mirrored."""
    long = cramers_v_pairs(df, list(combinations_with_replacement(columns, 2)))
    return _both_orders(long, "cramers_v")


def _both_orders(long: DataFrame, value: str) -> DataFrame:
    """(col_a, col_b) and, off the diagonal, (col_b, col_a) of every row."""
    one = F.struct(F.col("col_a"), F.col("col_b"))
    two = F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"))
    return (long.select(value, F.explode(F.when(F.col("col_a") == F.col("col_b"), F.array(one))
                                         .otherwise(F.array(one, two))).alias("p"))
            .select("p.col_a", "p.col_b", value))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed; every
    bin is listed, empty ones with 0."""
    x = F.col(column).cast("double")
    lo_hi = df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = lo_hi.getField("lo"), lo_hi.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / (hi - lo) * F.lit(bins)).cast("int"), F.lit(bins - 1)))
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    domain = spark.range(bins).select(F.col("id").cast("int").alias("bin"))  # fixed `bins` rows
    return (domain.join(F.broadcast(counts), "bin", "left")
                  .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                          (lo + (F.col("bin") + 1) * width).alias("bin_end"),
                          F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def box_summary(df: DataFrame, group: str, value: str, whisker: float = 1.5) -> DataFrame:
    """Per group quartiles, whiskers at the most extreme data points
    within ``whisker``·IQR of the quartiles, outlier count."""
    from .quantile import grouped_quantiles
    x = F.col(value).cast("double")
    # Exact quartiles without holding a (possibly huge) group in memory.
    q = grouped_quantiles(df, [group], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumns({"lo_fence": F.col("q1") - F.lit(whisker) * (F.col("q3") - F.col("q1")),
                       "hi_fence": F.col("q3") + F.lit(whisker) * (F.col("q3") - F.col("q1"))})
    q = cut_lineage(q)
    j = join_small(df.where(x.isNotNull()).select(group, x.alias("_v")), q.select(group, "lo_fence", "hi_fence"), group, "inner")
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    w = j.groupBy(group).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return q.join(w, group).drop("lo_fence", "hi_fence")


@dataclass(frozen=True)
class Profile:
    """The tables of ``profile_report``; those that depend on a choice of
    columns are None where nothing was chosen."""

    table: DataFrame            # the profiled columns, written
    shape: DataFrame            # D22: column, dtype, row_count, non_null
    nulls: DataFrame            # D20: column, null_count
    describe: DataFrame         # D21
    correlations: DataFrame     # D23, long
    target: DataFrame | None    # D24, ranked
    cramers_v: DataFrame | None  # D27, long
    histograms: dict[str, DataFrame]  # D28 by column
    boxes: DataFrame | None     # D29


def profile_report(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] = (),
                   target: str | None = None, histograms: list[str] = (), box: tuple[str, str] | None = None,
                   bins: int = 50) -> Profile:
    """The whole profile by one call.

    The source is read once: while the profiled columns are written, an
    ``Observation`` counts rows and values and takes the moments.  All else
    (quartiles, correlations, contingency, boxes) reads the written table.
    The tables are those of the single operators."""
    from .quantile import exact_quantiles
    numeric = numeric or numeric_columns(df)
    seen = Observation(f"profile-{uuid.uuid4().hex[:8]}")
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)]]
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        metrics += [F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    table = cut_lineage(df.observe(seen, *metrics))
    got, spark = seen.get, df.sparkSession
    counts = {c: got[f"n_{i}"] for i, c in enumerate(df.columns)}
    shape = spark.createDataFrame([(got["rows"], c, t, counts[c]) for c, t in df.dtypes],
                                  "row_count long, column string, dtype string, non_null long")
    nulls = shape.select("column", (F.col("row_count") - F.col("non_null")).alias("null_count"))
    quartiles = exact_quantiles(table, {c: [0.25, 0.5, 0.75] for c in numeric}, written=True)
    described = [(c, float(counts[c]), got[f"mean_{i}"], got[f"std_{i}"], got[f"min_{i}"], *quartiles[c], got[f"max_{i}"])
                 for i, c in enumerate(numeric)]
    return Profile(
        table, shape, nulls,
        spark.createDataFrame(described, "column string, count double, mean double, std double, min double, q25 double, q50 double, q75 double, max double"),
        correlation_matrix(table, numeric, written=True),
        target_correlations(table, target, numeric) if target else None,
        cramers_v_matrix(table, list(categorical)) if categorical else None,
        {c: histogram(table, c, bins) for c in histograms},
        box_summary(table, *box) if box else None)


def price_per_unit(df: DataFrame) -> DataFrame:
    """Dollars per bottle; zero bottles → NULL (pandas gives inf)."""
    return df.withColumn("price_per_unit", F.try_divide(F.col("sale_dollars"),
                                                        F.col("sale_bottles").cast("double")))


def bucket_small_categories(df: DataFrame, column: str = "category_name",
                            value: str = "sale_dollars", min_share: float = 0.01,
                            other: str = "Other") -> DataFrame:
    """Categories below ``min_share`` of the total become ``other``.
    The per-category shares are a grouped aggregate joined back."""
    totals = df.groupBy(column).agg(F.sum(value).alias("_cat_total"))
    grand = df.select(F.sum(value)).scalar()
    share = totals.withColumn("_share", F.try_divide(F.col("_cat_total"), grand))
    out = join_small(df, cut_lineage(share.select(column, "_share")), column)
    return out.withColumn(f"{column}_grouped",
                          F.when(F.col("_share") < min_share, F.lit(other)).otherwise(F.col(column))
                          ).drop("_share")


def volume_class(df: DataFrame, column: str = "bottle_volume_ml", limit: int = 2000) -> DataFrame:
    """Bottles above ``limit`` ml are 'large format'."""
    return df.withColumn("volume_class", F.when(F.col(column) > limit, F.lit("large format"))
                                           .otherwise(F.lit("standard")))


def decompose(df: DataFrame, key: str, order: str, value: str, period: int = 7) -> DataFrame:
    """Additive decomposition of daily series with gaps.  Everything
    goes by the calendar: the trend is the mean of the days present within
    half a ``period`` on either side; the seasonal part is the mean of what
    is left per day position (day number modulo the period, the weekday for
    7), centred to mean 0 over the positions present; the residual is the
    rest."""
    day = F.unix_date(order)
    h = period // 2
    around = Window.partitionBy(key).orderBy("_day").rangeBetween(-h, h)
    out = (df.withColumn("_day", day).withColumn("trend", F.avg(F.col(value)).over(around))
             .withColumn("_pos", F.pmod("_day", F.lit(period))))
    pos_mean = out.groupBy(key, "_pos").agg(F.avg(F.col(value) - F.col("trend")).alias("_pm"))
    pos_mean = pos_mean.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(key)))
    out = out.join(pos_mean.select(key, "_pos", "seasonal"), [key, "_pos"], "left")
    return (out.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
               .drop("_day", "_pos"))
