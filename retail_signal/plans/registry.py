"""Registry of named queries.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with an
optional ANSI SQL twin that DuckDB can run over the same parquet tables.
Builders return the library operator's result with doubles rounded to nine
places on both sides: enough to drop the noise of float sums near zero, and
below the last place of any amount, so no sum lies on a rounding tie.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import round_doubles
from ..sources.adapter import SALES_SQL, sales_from_tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, round_output: bool = True):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if round_output else df
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_from_tables(spark, sf_dir)


def with_ctes(*ctes: str) -> str:
    """``WITH sales AS (...), <ctes>`` prefix for oracle SQL."""
    return "WITH " + ",\n".join([SALES_SQL.strip(), *[c.strip() for c in ctes]]) + "\n"


def r6(expr: str, alias: str) -> str:
    """Rounded double in SQL, matching ``round_doubles``."""
    return f"ROUND(CAST({expr} AS DOUBLE), 9) AS {alias}"


def load_all() -> dict[str, Query]:
    # Importing the modules fills the registry.
    from . import (q_aggregate, q_columns, q_domains, q_operators, q_pipeline, q_profile,  # noqa: F401
                   q_series, q_streams, q_temporal)
    return REGISTRY
