"""Mixing sources to target weights by hash-threshold histograms.

Sources share a token budget by weight.  Each document has a hash of its id;
a source takes the documents whose hash lies below its threshold.  The
threshold comes from histograms, never from a sort of the documents:

1. tokens are summed by (source, top ``bits`` of the hash);
2. running sums over a source's buckets find the one bucket in which its
   budget ends;
3. only that bucket is summed again, by the next ``bits`` of the hash, and
   after ``levels`` rounds by the whole hash;
4. documents are filtered by ``hash <= threshold``.

Thresholds are nested: a larger budget takes a superset.  A source whose
target exceeds its size is taken whole as often as it fits, and the rest of
the target is drawn by threshold once more.

Only DataFrame functions run here.  A hot source never meets in one task:
sums are partial before each exchange, and the per-source table that joins
the documents is a few rows, read from Parquet so that its size is known.

Defined results: a null text has size 0; a null source is a source of its
own, ordered last; a null id hashes as the empty text; repeated ids share
their hash and thus their fate; an empty table gives an empty result; an
empty source has target 0.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, whole_text

HASH_BITS = 60


@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources in order; together the sources get
    ``share`` times all tokens, none more than ``max_copies`` times its own."""
    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    max_copies: int = 2
    bits: int = 12
    levels: int = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """A 60-bit hash: the first 15 hexadecimal digits of the id's MD5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       word_count(whole_text()).alias("size"), id_hash(F.col("doc_id")).alias("h"))


def targets(slim: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, source_size, target): weights fill up like water until each
    source meets its cap.

    Taking sources by cap per weight, a source is capped if its cap is below
    its share of what the sources before it (all capped) have left over.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    filled = (
        slim.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(weights, F.col("place") % len(spec.weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(spec.max_copies)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(spec.share)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") * F.col("open_weight") <= F.col("left") * F.col("weight"))
    )
    # From the first source that is not capped on, all share what is left.
    first_open = F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "left", "open_weight"))).over(everything)
    return filled.withColumn("open", first_open).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap"))
        .otherwise(F.col("weight") * F.col("open.left") / F.col("open.open_weight")).alias("target"))


def _crossing(hist: DataFrame, budgets: DataFrame, bin_col: str) -> DataFrame:
    """Per source the bin in which the running sum passes what is left of the
    budget, and what is left at its start.  Sources that end before have none."""
    run = Window.partitionBy("source").orderBy(bin_col)
    return (
        hist.join(budgets.select("b_source", "left"), F.col("source").eqNullSafe(F.col("b_source")))
        .withColumn("upto", F.sum("tokens").over(run))
        .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("tokens") <= F.col("left")))
        .select(F.col("source").alias("b_source"), F.col(bin_col).alias("b_bin"),
                (F.col("left") - (F.col("upto") - F.col("tokens"))).alias("left"))
    )


def thresholds(slim: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, source_size, target, base, h_max): each document is taken
    ``base`` times, and once more if its hash is at most ``h_max``."""
    spark = slim.sparkSession
    goal = targets(slim, spec)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goal = materialise(goal.withColumn("base", base)
                       .withColumn("left", F.col("target") - F.col("base") * F.col("source_size")), "mix-targets")
    edge = goal.where("left > 0").select(F.col("source").alias("b_source"), "left")
    rows, shift = slim, HASH_BITS
    for _ in range(spec.levels):
        shift -= spec.bits
        cell = F.shiftright("h", shift).alias("cell")
        hist = rows.groupBy("source", cell).agg(F.sum("size").alias("tokens"))
        edge = materialise(_crossing(hist, edge, "cell"), "mix-edge")
        e = edge.select(F.col("b_source").alias("e_source"), F.col("b_bin").alias("e_cell"))
        rows = slim.join(e, F.col("source").eqNullSafe(F.col("e_source"))
                         & (F.shiftright("h", shift) == F.col("e_cell"))).drop("e_source", "e_cell")
        edge = edge.select("b_source", "left", F.col("b_bin").alias("cell"))
    # The last bucket, by whole hashes: a hash is in while its middle is
    # within the budget.
    run = Window.partitionBy("source").orderBy("h")
    last = (
        rows.groupBy("source", "h").agg(F.sum("size").alias("tokens"))
        .join(edge, F.col("source").eqNullSafe(F.col("b_source")))
        .withColumn("upto", F.sum("tokens").over(run))
        .withColumn("inside", F.col("upto") - F.col("tokens") / 2 <= F.col("left"))
        .groupBy("source").agg(
            F.max(F.when(F.col("inside"), F.col("h"))).alias("h_in"),
            F.min(F.shiftleft("cell", shift)).alias("h_start"))
        .select(F.col("source").alias("l_source"),
                F.coalesce("h_in", F.col("h_start") - 1).alias("h_max"))
    )
    out = (goal.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
           .select("source", "source_size", "target", "base", F.coalesce("h_max", F.lit(-1)).alias("h_max")))
    return materialise(out, "mix-thresholds")


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source`` and ``h``) plus source_size, target and
    ``copies``, how often the mix takes the document."""
    p = plan.withColumnRenamed("source", "p_source")
    return (rows.join(p, F.col("source").eqNullSafe(F.col("p_source")), "left")
            .withColumn("copies", F.col("base") + (F.col("h") <= F.col("h_max")).cast("int"))
            .drop("p_source", "base", "h_max"))


def mix_table(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    slim = materialise(sizes(docs), "mix-sizes")
    return copies(slim, thresholds(slim, spec)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mixed documents, with the columns of ``docs``; a document taken
    twice comes twice."""
    plan = thresholds(materialise(sizes(docs), "mix-sizes"), spec)
    key = F.struct(F.col("source").cast("string").alias("source"), id_hash(F.col("doc_id")).alias("h"))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    chosen = copies(inner.select("row", "key.source", "key.h"), plan)
    return (chosen.where("copies > 0")
            .select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("nth"))
            .select("row.*"))


def op10_source_mix(spark, sf_dir):
    """All documents mixed with weights 5, 2, 1 and a share of 150 %."""
    from .common import table
    return mix_table(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][CAST(place % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM t),
f AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
o AS (SELECT min_by({'l': remaining, 'ow': open_weight}, (cap / weight, place)) AS x FROM f WHERE cap * open_weight > remaining * weight),
g AS (
  SELECT f.source, source_size,
         CASE WHEN cap * open_weight <= remaining * weight THEN cap ELSE weight * o.x.l / o.x.ow END AS target FROM f, o),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM g),
c AS (
  SELECT s.*, b.source_size, b.target, b.base, target - base * b.source_size AS extra,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS here
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN extra > 0 AND upto - here / 2 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
