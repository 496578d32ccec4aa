"""Series preparation: row-window features (I7; E14–E18), gap filling
(I8; C6, E20, H9, H15), supervised windows (I9; E21, B12) and the
chronological split (E22).

Every window is partitioned by the series key (Q8: no global window over
raw lines); a series has at most one row per calendar day.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_of_week, is_weekend
from ..session import cut_lineage
from .rank import global_offsets

# Fixed values of the row-feature notebook.
ROW_LAGS = [1, 7, 14, 30]
ROW_WINDOWS = [7, 14, 30]
SEQ_LEN = 30
HORIZON = 30
TRAIN_FRACTION = 0.8
WINDOW_FEATURES = ["sale_bottles", "pack", "bottle_volume_ml"]


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def row_features(df: DataFrame, key="store", order: str = "date",
                 value: str = "sale_dollars", prefix: str = "sales") -> DataFrame:
    """Row lags, full-window rolling mean/std/max/min, percent change
    (previous value forward-filled; zero base → NULL), first difference,
    momentum, and calendar parts."""
    v = F.col(value)
    w = Window.partitionBy(*_keys(key)).orderBy(order)
    cols = {f"{prefix}_lag_{k}": F.lag(v, k).over(w) for k in ROW_LAGS}
    for n in ROW_WINDOWS:
        fr = w.rowsBetween(-(n - 1), 0)
        full = F.count(v).over(fr) == n
        cols[f"{prefix}_rolling_mean_{n}"] = F.when(full, F.avg(v).over(fr))
        cols[f"{prefix}_rolling_std_{n}"] = F.when(full, F.stddev_samp(v).over(fr))
        cols[f"{prefix}_rolling_max_{n}"] = F.when(full, F.max(v).over(fr))
        cols[f"{prefix}_rolling_min_{n}"] = F.when(full, F.min(v).over(fr))
    filled = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_vf", filled).withColumns(cols)
    base = F.lag("_vf", 1).over(w)
    out = out.withColumns({
        f"{prefix}_pct_change": F.try_divide(F.col("_vf"), base) - F.lit(1.0),
        f"{prefix}_diff": v - F.lag(v, 1).over(w),
    })
    out = out.withColumns({f"{prefix}_momentum_{n}": v - F.col(f"{prefix}_rolling_mean_{n}")
                           for n in ROW_WINDOWS})
    d = F.col(order)
    return out.withColumns({
        "day_of_week": day_of_week(d), "month": F.month(d).cast("int"),
        "quarter": F.quarter(d).cast("int"), "year": F.year(d).cast("int"),
        "is_weekend": is_weekend(d)}).drop("_vf")


def fill_missing_dates(df: DataFrame, key=("store", "itemno"), date: str = "date",
                       zero_cols=("sale_bottles",), carry_cols=("pack", "bottle_volume_ml")) -> DataFrame:
    """I8: one row per calendar day between a series' first and last date;
    new days get 0 in ``zero_cols`` and the carried-forward value of
    ``carry_cols``.

    Each row is exploded into itself plus the missing days before the next
    row of its series (``lead`` on the series window), so no dense calendar
    is joined back: one exchange on the series key, output-sized work."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(date)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({c: F.last(F.col(c), True).over(before) for c in carry_cols})
    nxt = F.lead(F.col(date), 1).over(w)
    out = out.withColumn("_until", F.coalesce(F.date_sub(nxt, 1), F.col(date)))
    out = out.withColumn("_day", F.explode(F.sequence(F.col(date), F.col("_until"))))
    is_orig = F.col("_day") == F.col(date)
    sel = [F.col(k) for k in keys] + [F.col("_day").alias(date)]
    for c in df.columns:
        if c in keys or c == date:
            continue
        if c in zero_cols:
            sel.append(F.when(is_orig, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0))
                       .cast(df.schema[c].dataType).alias(c))
        elif c in carry_cols:
            sel.append(F.col(c))
        else:
            sel.append(F.when(is_orig, F.col(c)).alias(c))
    return out.select(*sel)


def minmax_fit(df: DataFrame, columns=WINDOW_FEATURES) -> DataFrame:
    """One row with ``<c>_min`` and ``<c>_range`` (0 range → 1)."""
    aggs = []
    for c in columns:
        aggs += [F.min(F.col(c)).cast("double").alias(f"{c}_min"),
                 F.max(F.col(c)).cast("double").alias(f"{c}_max")]
    fit = df.agg(*aggs)
    return fit.select(*[x for c in columns for x in (
        F.col(f"{c}_min"),
        F.when(F.col(f"{c}_max") - F.col(f"{c}_min") == 0, F.lit(1.0))
         .otherwise(F.col(f"{c}_max") - F.col(f"{c}_min")).alias(f"{c}_range"))])


def minmax_scale(df: DataFrame, columns=WINDOW_FEATURES, fit: DataFrame | None = None) -> DataFrame:
    """(x − min) / range with a fit from ``minmax_fit`` (evaluated as
    one scalar subquery)."""
    f = (fit if fit is not None else minmax_fit(df, columns))
    s = f.select(F.struct(*f.columns)).scalar()
    return df.withColumns({c: (F.col(c).cast("double") - s.getField(f"{c}_min")) / s.getField(f"{c}_range")
                           for c in columns})


def supervised_windows(df: DataFrame, key=("store", "itemno"), order: str = "date",
                       features=WINDOW_FEATURES, target: str = "sale_bottles",
                       seq_len: int = SEQ_LEN, horizon: int = HORIZON,
                       include_last: bool = False, require_positive: bool = True) -> DataFrame:
    """E21 + B12: for every start i of a series, ``x`` = the next
    ``seq_len`` rows of ``features`` and ``y`` = the ``horizon`` target
    values after them.  Starts run over range(n − seq_len − horizon)
    (``include_last`` adds the final valid start); windows whose target sum
    is not positive are dropped.  Arrays are built with bounded row frames
    (``seq_len`` / ``horizon`` rows)."""
    keys = _keys(key)
    out = _marked_windows(df, keys, order, target, seq_len, horizon, include_last, require_positive, features)
    return out.where("_keep").select(*keys, "i", F.col(order).alias("window_start"), "x", "y")


def _marked_windows(df, keys, order, target, seq_len, horizon, include_last, require_positive, features=None) -> DataFrame:
    """Every start with its target array, whether it is a sample (``_keep``)
    and, if ``features`` are named, its inputs."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    extra = []
    if features:
        rec = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
        extra = [F.collect_list(rec).over(w.rowsBetween(0, seq_len - 1)).alias("x")]
    out = df.select(*keys, order, (F.row_number().over(w) - 1).cast("int").alias("i"), n.alias("_n"), *extra,
                    F.collect_list(F.col(target).cast("double")).over(
                        w.rowsBetween(seq_len, seq_len + horizon - 1)).alias("y"))
    last = F.col("_n") - seq_len - horizon
    keep = (F.col("i") <= last) if include_last else (F.col("i") < last)
    if require_positive:
        keep = keep & (F.aggregate("y", F.lit(0.0), lambda s, v: s + v) > 0)
    return out.withColumn("_keep", keep)


def split_windows(df: DataFrame, key=("store", "itemno"), order: str = "date", features=WINDOW_FEATURES,
                  target: str = "sale_bottles", seq_len: int = SEQ_LEN, horizon: int = HORIZON,
                  include_last: bool = False, require_positive: bool = True,
                  fraction: float = TRAIN_FRACTION, part: str | None = None) -> DataFrame:
    """``supervised_windows`` and ``chronological_split`` in one: the samples
    with ``sample_index`` and ``split``, or one ``part`` of them.

    The samples of each series are counted first, without their inputs; what
    stays is one row per series, its offset among all samples.  Only then are
    arrays built, and only for series that reach into ``part``; a sample's
    rank is a running count in the same window pass."""
    keys = _keys(key)
    counted = (_marked_windows(df, keys, order, target, seq_len, horizon, include_last, require_positive)
               .groupBy(*keys).agg(F.count_if("_keep").alias("_n")))
    sizes = cut_lineage(global_offsets(counted, keys, "_n", "_offset"))
    cut = math.floor((sizes.agg(F.sum("_n")).first()[0] or 0) * fraction)
    if part == "train":
        sizes = sizes.where(F.col("_offset") < cut)
    elif part == "validation":
        sizes = sizes.where(F.col("_offset") + F.col("_n") > cut)
    rows = df.join(sizes.select(*keys), keys, "left_semi") if part else df
    marked = _marked_windows(rows, keys, order, target, seq_len, horizon, include_last, require_positive, features)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_rank", F.sum(F.col("_keep").cast("int")).over(before) - 1).where("_keep")
    out = marked.join(sizes.select(*keys, "_offset"), keys).withColumn("sample_index", F.col("_offset") + F.col("_rank"))
    out = out.withColumn("split", F.when(F.col("sample_index") < cut, F.lit("train")).otherwise(F.lit("validation")))
    if part:
        out = out.where(F.col("split") == part)
    return out.select(*keys, "i", F.col(order).alias("window_start"), "x", "y", "sample_index", "split")


def chronological_split(samples: DataFrame, key=("store", "itemno"), fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Sample positions in (series, i) order; the first
    floor(fraction·total) samples are 'train', the rest 'validation'.

    A position is the offset of the series (from one row per series) plus
    the rank within it, so the samples' arrays are neither sorted globally
    nor written: they stay where the series' windows left them."""
    keys = _keys(key)
    sizes = global_offsets(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", "_offset")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    cut = math.floor(total * fraction)
    w = Window.partitionBy(*keys).orderBy("i")
    out = samples.withColumn("_rank", F.row_number().over(w) - 1).join(sizes.drop("_n"), keys)
    out = out.withColumn("sample_index", F.col("_offset") + F.col("_rank")).drop("_offset", "_rank")
    return out.withColumn("split", F.when(F.col("sample_index") < cut, F.lit("train")).otherwise(F.lit("validation")))
