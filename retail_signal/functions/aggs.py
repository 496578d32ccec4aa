"""Aggregate expressions with pandas semantics.

All are built-in Spark aggregates, so Catalyst splits them into partial
(map-side) and final phases.  Exact medians use ``percentile``, whose buffer
is a value→count map: its size is bounded by the distinct values of a
group, not by its rows, and partial buffers merge before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


def pd_sum(c) -> Column:
    """``sum``; an all-NULL (or empty) group gives 0 as in pandas."""
    s = F.sum(col(c))
    return F.coalesce(s, F.lit(0))


def pd_mean(c) -> Column:
    return F.avg(col(c))


def pd_median(c, exact: bool = True, accuracy: int = 100000) -> Column:
    """Median with linear interpolation (exact); ``percentile_approx`` when
    ``exact=False`` for a bounded sketch buffer on very wide groups."""
    if exact:
        return F.percentile(col(c), F.lit(0.5))
    return F.percentile_approx(col(c), 0.5, accuracy).cast("double")


def pd_std(c) -> Column:
    """Sample standard deviation; one value → NULL."""
    return F.stddev_samp(col(c))


def pd_skew(c) -> Column:
    """Bias-corrected sample skewness (pandas ``skew``).

    Spark's ``skewness`` is the population moment ratio g1; pandas returns
    G1 = g1·sqrt(n(n−1))/(n−2) for n ≥ 3, NULL below, 0 for a constant
    group (where ``skewness`` is NULL).
    """
    n = F.count(col(c)).cast("double")
    g1 = F.skewness(col(c))
    return F.when(n >= 3, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def pd_sem(c) -> Column:
    """Standard error of the mean: sample std / sqrt(n)."""
    return F.stddev_samp(col(c)) / F.sqrt(F.count(col(c)).cast("double"))


def pd_count(c) -> Column:
    return F.count(col(c))


def pd_nunique(c) -> Column:
    """Distinct non-NULL values.  ``count(DISTINCT)`` is planned with a
    shuffle on (keys, value) first, so a hot group is spread over tasks."""
    return F.count_distinct(col(c))


def pd_min(c) -> Column:
    return F.min(col(c))


def pd_max(c) -> Column:
    return F.max(col(c))


def first_non_null(c, *order) -> Column:
    """First non-NULL value in the given order (pandas ``first`` after a
    sort).  Deterministic, unlike ``first``: ties broken by the value."""
    key = F.struct(*[col(o) for o in order], col(c).alias("_v"))
    return F.min_by(col(c), F.when(col(c).isNotNull(), key))


AGG_FUNCS = {
    "sum": pd_sum, "mean": pd_mean, "median": pd_median, "std": pd_std,
    "min": pd_min, "max": pd_max, "skew": pd_skew, "sem": pd_sem,
    "count": pd_count, "nunique": pd_nunique,
}
