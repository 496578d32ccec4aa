"""Connected components of a link table, by alternating star contractions.

Large-star links every neighbour above a node to the node's least neighbour;
small-star links the neighbours below to the least.  Both only group by a node
and take a minimum, so a hub needs no list of its neighbours in one place, and
a chain shortens by a constant factor in each round.  Every round is written
to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(links: DataFrame) -> DataFrame:
    """One round over (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (both.where("v > u").join(least, F.col("u") == F.col("n"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
    large = materialise(large, "large-star")
    low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    small = (large.join(low, F.col("u") == F.col("n"))
             .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                       F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
             .select("e.u", "e.v").where("u > v").distinct())
    return materialise(small, "small-star")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v), root the least node
    that it reaches; nodes without links are not listed."""
    links = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u > v").distinct(), "links")
    # Done when the same links come out: then every node links to its root.
    mark = _mark(links)
    while True:
        links = _stars(links)
        new = _mark(links)
        if new == mark:
            break
        mark = new
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
