"""Per-series time features (I3, E1–E13) on store-day rows.

All frames use ``Window.partitionBy(key).orderBy(day_number)``; every
frame shares one hash exchange on ``key`` and one sort, and each frame
spec adds only a Window operator.  A series holds at most one row per
calendar day, so the widest frame (90 days) bounds the per-row work and a
series is bounded by the calendar span whatever the line volume.

``method="runs"`` measures the same frames over whole series in Arrow batches:
all rows of a batch at once, the k-th row of every frame after the other, in the
order and by the formulas of Spark's aggregates.  Spark's window evaluates
every frame anew, row by row.  It takes series that are dealt and sorted
already as they come (``dealt``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.scalar import cyclic, day_number, flag, safe_div
from .runs import map_series

# Calendar lags (days) and rolling windows (days).
LAG_DAYS = [1, 7, 14, 30, 60]
ROLLING_DAYS = [7, 14, 30, 60, 90]
SIGNIFICANT_DROP = 0.9

DN = "_dn"


def series_window(key: str | list[str] = "store", order: str = DN) -> Window:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def calendar_lag(target: str, days: int, w: Window):
    """Value exactly ``days`` calendar days earlier, NULL if that
    day has no row (the range frame [-k, -k] holds at most one row)."""
    return F.first(F.col(target)).over(w.rangeBetween(-days, -days))


def rolling_frame(w: Window, days: int) -> Window:
    """Time window (t − days, t] with at least one row (pandas ``'7D'``)."""
    return w.rangeBetween(-(days - 1), 0)


def temporal_features(df: DataFrame, target: str = "sale_dollars",
                      key: str = "store", date: str = "date",
                      lags=LAG_DAYS, windows=ROLLING_DAYS,
                      with_median: bool = True, method: str = "windows", dealt: bool = False) -> DataFrame:
    """Lags, rolling mean/std/max/min/median, purchase gap, momentum,
    decline flags and cyclic month / day encodings.

    ``method``: 'windows' (Spark's window operator) or 'runs' (whole series in
    Arrow batches, for a target of doubles and a key that is no double)."""
    t = F.col(target)
    out = df.withColumn(DN, day_number(date))
    if method == "runs":
        out = _measured_frames(out, target, key, lags, windows, with_median, dealt)
        falls = two_declines(t, F.col(PREV[0]), F.col(PREV[1]))
        return derived_features(out, F.col(DN) - F.col(PREV_DAY), falls, target, date, lags, windows).drop(DN, *PREV, PREV_DAY)
    w = series_window(key)
    w_all = Window.partitionBy(key)
    cols = {}
    for k in lags:
        cols[f"{target}_lag_{k}d"] = calendar_lag(target, k, w)
    n_rows = F.count(F.lit(1)).over(w_all)
    span = F.datediff(F.max(date).over(w_all), F.min(date).over(w_all))
    gap = safe_div(span, n_rows - 1)
    for d in windows:
        lab = f"{d}D"
        fr = rolling_frame(w, d)
        mean = F.avg(t).over(fr)
        cols[f"{target}_rolling_mean_{lab}"] = mean
        cols[f"{target}_rolling_std_{lab}"] = F.stddev_samp(t).over(fr)
        cols[f"{target}_rolling_max_{lab}"] = F.max(t).over(fr)
        cols[f"{target}_rolling_min_{lab}"] = F.min(t).over(fr)
        if with_median:
            # ``median`` is refused with an ORDER BY frame; percentile is not.
            cols[f"{target}_rolling_median_{lab}"] = F.percentile(t, F.lit(0.5)).over(fr)
        cols[f"avg_days_between_purchases_{lab}"] = gap
    out = out.withColumns(cols)
    since = F.datediff(F.col(date), F.lag(F.col(date), 1).over(w))
    falls = two_declines(t, F.lag(t, 1).over(w), F.lag(t, 2).over(w))
    return derived_features(out, since, falls, target, date, lags, windows).drop(DN)


def two_declines(t, prev1, prev2):
    """Two declines in a row over the last three rows (row based); fewer than
    three rows leave a NULL operand and therefore 0."""
    return flag((t < prev1) & (prev1 < prev2))


def derived_features(out: DataFrame, since, falls, target: str = "sale_dollars", date: str = "date",
                     lags=LAG_DAYS, windows=ROLLING_DAYS) -> DataFrame:
    """What follows from a row's lags and frames: momentum, decline flags and
    cyclic codes, beside the days ``since`` the previous row and ``falls``."""
    t = F.col(target)
    derived = {}
    for d in windows:
        lab = f"{d}D"
        mean = F.col(f"{target}_rolling_mean_{lab}")
        derived[f"{target}_momentum_{lab}"] = t - mean
        derived[f"{target}_rel_momentum_{lab}"] = (safe_div(t, mean) - F.lit(1.0)) * F.lit(100.0)
    # Intent of the reference: days since this series' previous row.
    derived["days_since_last_purchase"] = since
    if 1 in lags:
        derived[f"{target}_decrease_prev"] = flag(t < F.col(f"{target}_lag_1d"))
    if 7 in windows:
        derived[f"{target}_decrease_7d_avg"] = flag(t < F.col(f"{target}_rolling_mean_7D"))
    if 30 in windows:
        m30 = F.col(f"{target}_rolling_mean_30D")
        derived[f"{target}_decrease_30d_avg"] = flag(t < m30)
        derived[f"{target}_significant_decrease"] = flag(t < m30 * F.lit(SIGNIFICANT_DROP))
    derived["consecutive_decrease"] = falls
    derived["month_sin"] = cyclic(F.month(date), 12, "sin")
    derived["month_cos"] = cyclic(F.month(date), 12, "cos")
    derived["day_of_month_sin"] = cyclic(F.dayofmonth(date), 31, "sin")
    derived["day_of_month_cos"] = cyclic(F.dayofmonth(date), 31, "cos")
    return out.withColumns(derived)


PREV, PREV_DAY = ("_prev1", "_prev2"), "_prev_day"
#: Cells of a batch that are sorted at once for the medians.
CELLS = 1 << 21


def _frames(x: np.ndarray, there: np.ndarray, low: np.ndarray, high: np.ndarray, with_median: bool) -> list[pa.Array]:
    """Mean, sample deviation, greatest, least (and middle) value of the rows
    [low, high) of every row, as Spark's aggregates add them up: NULLs left
    out, the moments by running updates, NaN above all."""
    n = len(x)
    order = np.argsort(low - high, kind="stable")  # longest frames first
    low, length = low[order], (high - low)[order]
    longest = int(length[0]) if n else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")
    count, total, mean, m2 = (np.zeros(n) for _ in range(4))
    most, least = np.full(n, -np.inf), np.full(n, np.nan)
    whole = bool(there.all())
    for k in range(longest):
        m = active[k]
        at = low[:m] + k
        v = x[at]
        if whole:
            rows = slice(0, m)
        else:
            rows = np.flatnonzero(there[at])
            v = v[rows]
        count[rows] += 1.0
        total[rows] += v
        delta = v - mean[rows]
        step = delta / count[rows]
        mean[rows] += step
        m2[rows] += delta * (delta - step)
        most[rows] = np.maximum(most[rows], v)
        least[rows] = np.fmin(least[rows], v)
    some, several = count > 0, count > 1
    made = [(np.divide(total, count, out=np.zeros(n), where=some), some),
            (np.sqrt(np.divide(m2, count - 1, out=np.zeros(n), where=several)), several), (most, some), (least, some)]
    if with_median:
        middle, known = np.zeros(n), np.where(there, x, np.nan)
        first = 0
        while first < n:
            width = int(length[first])
            rows = slice(first, min(n, first + max(1, CELLS // width)))
            at = low[rows, None] + np.arange(width)
            inside = np.arange(width) < length[rows, None]
            cells = np.sort(np.where(inside, known[np.minimum(at, n - 1)], np.nan), axis=1)  # others come last
            c = np.maximum(count[rows].astype(int), 1)[:, None]
            a, b = np.take_along_axis(cells, (c - 1) // 2, 1)[:, 0], np.take_along_axis(cells, c // 2, 1)[:, 0]
            middle[rows] = np.where(a == b, a, 0.5 * a + 0.5 * b)
            first = rows.stop
        made.append((middle, some))
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return [pa.array(v[back], mask=~known[back]) for v, known in made]


def _measured_frames(df: DataFrame, target: str, key: str, lags, windows, with_median: bool, dealt: bool) -> DataFrame:
    """``df`` (with day numbers) and its lags, frames, purchase gap and the two
    rows before."""
    if not isinstance(df.schema[target].dataType, DoubleType):
        raise TypeError(f"{target} is no double: use method='windows'")
    kinds = ["mean", "std", "max", "min", *(["median"] if with_median else [])]
    names = [f"{target}_lag_{k}d" for k in lags]
    for d in windows:
        names += [*[f"{target}_rolling_{kind}_{d}D" for kind in kinds], f"avg_days_between_purchases_{d}D"]
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in (*names, *PREV)], StructField(PREV_DAY, IntegerType())])
    reach = max([*lags, *windows, 1])

    def make(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = len(table)
        sizes = np.diff(np.append(starts, n))
        series = np.repeat(np.arange(len(starts)), sizes)
        days = table.column(DN).combine_chunks()
        dated = days.is_valid().to_numpy(zero_copy_only=False)
        day = days.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = table.column(target).combine_chunks()
        there = values.is_valid().to_numpy(zero_copy_only=False)
        x = values.fill_null(0.0).to_numpy(zero_copy_only=False)
        # One ascending number for (series, NULL days first, day): the frames of
        # all series are found at once, and none reaches into another.
        earliest = day[dated].min() if dated.any() else 0
        since = np.where(dated, day - earliest, 0)
        place = (2 * series + dated) * (since.max() + reach + 1) + since
        end = np.searchsorted(place, place, "right")
        out = []
        for k in lags:
            wanted = np.where(dated, place - k, place)
            at = np.minimum(np.searchsorted(place, wanted, "left"), n - 1)
            out.append(values.take(pa.array(at, mask=place[at] != wanted)))
        least = np.minimum.reduceat(np.where(dated, day, np.iinfo(np.int64).max), starts)
        most = np.maximum.reduceat(np.where(dated, day, np.iinfo(np.int64).min), starts)
        spread = (sizes > 1) & (least <= most)
        gap = np.divide(np.where(spread, most - least, 0).astype(float), sizes - 1, out=np.zeros(len(sizes)), where=spread)
        gap = pa.array(gap[series], mask=~spread[series])
        for d in windows:
            begin = np.searchsorted(place, np.where(dated, place - (d - 1), place), "left")
            out += [*_frames(x, there, begin, end, with_median), gap]
        rows = np.arange(n)

        def before(c, k):
            return c.take(pa.array(np.maximum(rows - k, 0), mask=rows - k < starts[series]))
        out += [before(values, 1), before(values, 2), before(days, 1)]
        for c, cells in zip((*names, *PREV, PREV_DAY), out):
            table = table.append_column(c, cells)
        return table
    return map_series(df, key, DN, make, schema, dealt)
