"""Scalar column functions with pandas-compatible semantics.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_map(expr: Column, mapping: dict) -> Column:
    """``CASE expr WHEN k THEN v ... END`` from a small fixed mapping."""
    out = None
    for k, v in mapping.items():
        out = (F.when(expr == F.lit(k), F.lit(v)) if out is None
               else out.when(expr == F.lit(k), F.lit(v)))
    return out


# --- H12 / H13: ratios ------------------------------------------------------

def safe_div(a, b) -> Column:
    """a / b with a zero (or NULL) denominator giving NULL (pandas
    ``b.replace(0, nan)``).  ``try_divide`` never raises under ANSI mode."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


# --- B9 / B10: predicates to 0/1 ---------------------------------------------

def flag(cond: Column) -> Column:
    """Boolean → 0/1 where NULL (comparison with a missing value) gives 0,
    as ``(a < b).astype(int)`` does in pandas."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def is_in_flag(c, values) -> Column:
    return flag(col(c).isin(*values))


# --- H1–H6, H10: calendar parts ---------------------------------------------

def day_of_week(d) -> Column:
    """Monday = 0 … Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(col(d)).cast("int")


def is_weekend(d) -> Column:
    return is_in_flag(day_of_week(d), [5, 6])


def week_of_year(d) -> Column:
    """ISO-8601 week number (2021-01-01 → 53)."""
    return F.weekofyear(col(d)).cast("int")


def weekday_name(d) -> Column:
    return F.date_format(col(d), "EEEE")


def first_of_month(year, month) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def date_text(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


def day_number(d) -> Column:
    """Days since 1970-01-01; the ordering key of calendar range frames."""
    return F.unix_date(col(d))


# --- H11: cyclic encodings ---------------------------------------------------

def cyclic(value, period: float, fn: str = "sin") -> Column:
    angle = F.lit(2.0 * math.pi) * col(value).cast("double") / F.lit(float(period))
    return F.sin(angle) if fn == "sin" else F.cos(angle)


# --- H17: geo point text -----------------------------------------------------

GEO_SCHEMA = "type string, coordinates array<double>"


def geo_point(text) -> Column:
    """Parse ``{'type': 'Point', 'coordinates': [lon, lat]}`` into a struct.
    Single quotes are accepted by the JSON reader; bad text gives NULL."""
    return F.from_json(col(text), GEO_SCHEMA,
                       {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def geo_lon(text) -> Column:
    return F.get(geo_point(text).getField("coordinates"), 0)


def geo_lat(text) -> Column:
    return F.get(geo_point(text).getField("coordinates"), 1)


# --- H19: min-max scaling ------------------------------------------------------

def minmax_transform(v, vmin, vrange) -> Column:
    return (col(v) - col(vmin)) / col(vrange)


def minmax_inverse(p, vmin, vrange) -> Column:
    return col(p) * col(vrange) + col(vmin)


# --- H20: label joining ------------------------------------------------------

def join_label(*parts: str) -> str:
    """``'_'.join(parts).strip('_')`` at plan time (column naming)."""
    return "_".join(p for p in parts).strip("_")


def join_label_col(*cols) -> Column:
    return F.regexp_replace(F.concat_ws("_", *[col(c) for c in cols]), "^_+|_+$", "")


def round_doubles(df, digits: int = 9):
    """Round every double column (presentation step used before comparing
    two engines whose float sums differ in the last bits)."""
    from pyspark.sql.types import DoubleType, FloatType

    def rounded(f):
        x = F.col(f.name)
        if isinstance(f.dataType, DoubleType):
            return round_double(x, digits).alias(f.name)
        return F.round(x, digits).alias(f.name) if isinstance(f.dataType, FloatType) else x
    return df.select([rounded(f) for f in df.schema.fields])


def round_double(x, digits: int) -> Column:
    """``round`` of a double, the same bits.  ``round`` goes through a decimal
    text; away from ties and while x·10^digits is exact to a tenth, the
    nearest whole number over 10^digits is that very double."""
    power = F.lit(float(10 ** digits))
    scaled = x * power
    near = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(5e14)) & (F.abs(scaled - near) < F.lit(0.25))
    return F.when(plain, near / power + F.lit(0.0)).otherwise(F.round(x, digits))
