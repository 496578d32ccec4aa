"""Global row index without a single-partition window.

Rows are range-partitioned on the sort keys and sorted inside each
partition, which then numbers its rows locally; a running sum over the per-partition counts (one row per
partition) gives each partition's offset.  Used by paging (A3) and the
chronological sample split (E22).  The numbered rows are checkpointed
(shared checkpoint folder) because range bounds are sampled per evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_index(df: DataFrame, keys: list[Column], name: str = "row_index") -> DataFrame:
    """Add a 0-based dense position of each row in the total order ``keys``
    (``keys`` must make the order total)."""
    # One range exchange and a sort inside each partition; the local
    # position comes from ``monotonically_increasing_id`` (partition id in
    # the upper 31 bits, row position in the lower 33), evaluated in the same
    # task right after the sort — no second exchange on the partition id.
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    local = ranged.withColumn(
        "_local", F.col("_mid") - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_mid")
    # Range bounds come from sampling, and partition ids are only stable
    # within one evaluation: materialise once so the per-partition counts
    # and the rows they offset are the same rows.
    local = cut_lineage(local, "zstd")  # whole rows: written once, read twice
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum is over the partition count only.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    return (local.join(F.broadcast(offsets), "_part")
                 .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
                 .drop("_part", "_local", "_offset"))


def global_offsets(df: DataFrame, keys: list[str], value: str, name: str = "offset") -> DataFrame:
    """Add the sum of ``value`` over all rows before a row in the order of
    ``keys``: range partitions, running sums inside them, and one row per
    partition for what comes before it."""
    dealt = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(F.broadcast(base), "_part")  # one row per partition
            .withColumn(name, (F.col("_base") + F.col("_run")).cast("long")).drop("_part", "_run", "_base"))
