"""Invoice-line (``sales``) view over the star-schema test tables.

One row per ``lineitem`` joined to supplier, nation, region and part.  The
same mapping is written twice: as DataFrame code (what the library runs) and
as SQL (``SALES_SQL``, the oracle twin DuckDB runs for the correctness
check).  Keep both in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import case_map

# Fixed values of the adapter.
# p_type → category number (alphabetical order of the six part types).
CATEGORY_OF_TYPE = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4,
                    "SMALL": 5, "STANDARD": 6}
# p_partkey % 5 → bottle volume in ml.
VOLUME_OF_MOD5 = {0: 50, 1: 375, 2: 750, 3: 1000, 4: 1750}
LITERS_TO_GALLONS = 0.264172

SALES_COLUMNS = [
    "invoice_line_no", "date", "store", "name", "address", "city", "zipcode",
    "store_location", "county", "category", "category_name", "itemno",
    "im_desc", "pack", "bottle_volume_ml", "state_bottle_cost",
    "state_bottle_retail", "sale_bottles", "sale_dollars", "sale_liters",
    "sale_gallons",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _location_text(nationkey: Column) -> Column:
    lon = (F.lit(-90.0) - F.lit(0.25) * nationkey).cast("string")
    lat = (F.lit(40.0) + F.lit(0.125) * nationkey).cast("string")
    return F.concat(F.lit("{'type': 'Point', 'coordinates': ["), lon,
                    F.lit(", "), lat, F.lit("]}"))


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table columns of which ``sales_columns`` makes an invoice line:
    what a step that moves whole lines should move, for they are narrower.

    The dimension joins are plain equi-joins: nation / region are fixed
    size, supplier and part grow with the scale factor, so the join strategy
    is left to AQE's runtime size check instead of a blind broadcast hint.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    sup = read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", "p_retailprice")

    # Lines meet each growing dimension directly (a pre-joined
    # supplier⋈nation⋈region side would get a product size estimate and
    # lose its broadcast); nation and region are fixed-size.  Part, the larger
    # one, comes first: if it is shuffled, lines move before they get wider.
    j = (li.join(part, li.l_partkey == part.p_partkey, "left")
           .join(sup, li.l_suppkey == sup.s_suppkey, "left")
           .join(F.broadcast(nat), F.col("s_nationkey") == nat.n_nationkey, "left")
           .join(F.broadcast(reg), F.col("n_regionkey") == reg.r_regionkey, "left"))
    return j.drop("l_partkey", "n_nationkey", "n_regionkey", "r_regionkey")


def sales_columns() -> dict[str, Column]:
    """The 21 columns of ``sales`` over ``joined_lines``."""
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1),
                  F.lit(-1)).otherwise(F.lit(1))
    volume = case_map(F.col("p_partkey") % 5, VOLUME_OF_MOD5).cast("int")
    bottles = (sign * F.col("l_quantity").cast("int")).cast("int")
    liters = bottles * volume / F.lit(1000.0)
    return {
        "invoice_line_no": F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                                     F.col("l_linenumber").cast("string")),
        "date": F.col("l_shipdate").cast("date"),
        "store": F.col("l_suppkey"),
        "name": F.col("s_name"),
        "address": F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main St")),
        "city": F.col("n_name"),
        "zipcode": (F.lit(50000) + F.col("s_nationkey")).cast("string"),
        "store_location": _location_text(F.col("s_nationkey")),
        "county": F.col("r_name"),
        "category": case_map(F.col("p_type"), CATEGORY_OF_TYPE).cast("bigint"),
        "category_name": F.col("p_type"),
        "itemno": F.col("p_partkey"),
        "im_desc": F.col("p_name"),
        "pack": (F.lit(1) + F.col("p_partkey") % 48).cast("int"),
        "bottle_volume_ml": volume,
        "state_bottle_cost": F.col("p_retailprice"),
        "state_bottle_retail": F.col("p_retailprice") * F.lit(1.5),
        "sale_bottles": bottles,
        "sale_dollars": sign * F.col("l_extendedprice"),
        "sale_liters": liters,
        "sale_gallons": liters * F.lit(LITERS_TO_GALLONS),
    }


def sales_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the 21-column ``sales`` frame."""
    return joined_lines(spark, sf_dir).select(*[c.alias(k) for k, c in sales_columns().items()])


def _sql_case(expr: str, mapping: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


# SQL twin of ``sales_from_tables`` for the DuckDB oracle.
SALES_SQL = f"""
sales AS (
  SELECT
    'INV-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS invoice_line_no,
    CAST(l.l_shipdate AS DATE) AS date,
    l.l_suppkey AS store,
    s.s_name AS name,
    CAST(s.s_suppkey AS VARCHAR) || ' Main St' AS address,
    n.n_name AS city,
    CAST(50000 + s.s_nationkey AS VARCHAR) AS zipcode,
    '{{''type'': ''Point'', ''coordinates'': [' || CAST(CAST(-90.0 AS DOUBLE) - CAST(0.25 AS DOUBLE) * s.s_nationkey AS VARCHAR)
      || ', ' || CAST(CAST(40.0 AS DOUBLE) + CAST(0.125 AS DOUBLE) * s.s_nationkey AS VARCHAR) || ']}}' AS store_location,
    r.r_name AS county,
    CAST({_sql_case('p.p_type', CATEGORY_OF_TYPE)} AS BIGINT) AS category,
    p.p_type AS category_name,
    p.p_partkey AS itemno,
    p.p_name AS im_desc,
    CAST(1 + p.p_partkey % 48 AS INTEGER) AS pack,
    CAST({_sql_case('p.p_partkey % 5', VOLUME_OF_MOD5)} AS INTEGER) AS bottle_volume_ml,
    p.p_retailprice AS state_bottle_cost,
    p.p_retailprice * CAST(1.5 AS DOUBLE) AS state_bottle_retail,
    CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -1 ELSE 1 END
         * CAST(l.l_quantity AS INTEGER) AS INTEGER) AS sale_bottles,
    CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -1 ELSE 1 END
         * l.l_extendedprice AS sale_dollars,
    CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -1 ELSE 1 END
         * CAST(l.l_quantity AS INTEGER) AS INTEGER)
         * CAST({_sql_case('p.p_partkey % 5', VOLUME_OF_MOD5)} AS INTEGER) / CAST(1000.0 AS DOUBLE) AS sale_liters,
    CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -1 ELSE 1 END
         * CAST(l.l_quantity AS INTEGER) AS INTEGER)
         * CAST({_sql_case('p.p_partkey % 5', VOLUME_OF_MOD5)} AS INTEGER) / CAST(1000.0 AS DOUBLE)
         * CAST({LITERS_TO_GALLONS} AS DOUBLE) AS sale_gallons
  FROM lineitem l
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""
