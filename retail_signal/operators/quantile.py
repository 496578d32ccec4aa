"""Exact quantiles without a single-task merge.

``percentile`` over a whole column merges a value→count map of every
distinct value in one final task, which does not survive a column with
billions of distinct values.  Here the quantile is found by narrowing:

1. one aggregate gives n per column; the target ranks are floor / ceil of
   p·(n − 1) (linear interpolation, as pandas and ``QUANTILE_CONT``);
2. each round, one aggregate takes ``percentile_approx`` brackets of the
   rows still inside each target's interval (rank error ≤ rows / accuracy),
   and a second counts exactly the rows below the brackets and below the
   interval's middle in the order of the doubles' bit patterns; every count
   moves a bound, and the interval always holds the rank;
3. a target is resolved when a counted value itself is the value at that
   rank, or the interval holds one double only.

On usual data a round shrinks an interval by about accuracy / 4 and two or
three rounds do.  The middle halves the 2^64 patterns whatever the data and
the accuracy, so there are at most 64 rounds.  Every pass is a global
aggregate with one output row: the work is spread over all tasks and nothing
but those rows reaches the driver.
"""

from __future__ import annotations

import math
import struct
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCURACY = 10_000


def place_of(x: float) -> int:
    """The place of a double among all doubles, by its bit pattern."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def double_at(place: int) -> float:
    x = struct.unpack("<d", struct.pack("<q", abs(place)))[0]
    return x if place >= 0 else -x


class _Target:
    """The search for the value at one rank: it lies in (lo, hi], places of
    doubles; ``below`` rows are at or under lo, ``rows`` in the interval."""

    def __init__(self, column: str, rank: int, low: float, high: float, rows: int):
        self.column, self.rank, self.below, self.rows = column, rank, 0, rows
        self.lo, self.hi, self.value = place_of(low) - 1, place_of(high), None
        self._settle()

    def _settle(self):
        if self.hi - self.lo == 1:
            self.value = double_at(self.hi)

    def around(self, accuracy: int) -> list[float]:
        """The shares of the interval's rows just before and after the rank."""
        rel = (self.rank - self.below) / max(self.rows - 1, 1)
        return [max(0.0, rel - 2.0 / accuracy), min(1.0, rel + 2.0 / accuracy)]

    def inside(self):
        """Whether the column's value lies in the interval."""
        x = F.col(self.column)
        inside = (x <= F.lit(double_at(self.hi)))
        return inside & (x > F.lit(double_at(self.lo))) if self.below else inside

    def middle(self) -> float:
        return double_at((self.lo + self.hi) // 2)

    def learn(self, x: float, le: int, lt: int) -> None:
        """``le`` rows are at or under ``x``, ``lt`` under it."""
        at = place_of(x)
        if self.value is not None or not self.lo < at <= self.hi:
            return
        if lt <= self.rank < le:
            self.value = double_at(at)
        elif le <= self.rank:
            self.rows -= le - self.below
            self.lo, self.below = at, le
        else:
            # Nothing above the greatest double under x can be it.
            self.rows = lt - self.below
            self.hi = at - 1
        if self.value is None:
            self._settle()


def exact_quantiles(df: DataFrame, spec: dict[str, list[float]], *, accuracy: int = ACCURACY,
                    trace: list | None = None, written: bool = False) -> dict[str, list]:
    """``{column: [p, ...]}`` → ``{column: [quantile, ...]}`` (NULL and NaN
    ignored; an empty column gives None).  ``trace`` receives the number of
    open targets of every round.  ``written``: ``df`` is a written table."""
    cols = list(spec)
    base = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    if not written:  # once: every pass reads these columns, not the plan behind them
        base = cut_lineage(base)
    first = base.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                       for c in cols]).first()
    counts = {c: first[c].n for c in cols}
    targets: dict[tuple[str, int], _Target] = {}
    for c in cols:
        for p in spec[c] if counts[c] else ():
            pos = p * (counts[c] - 1)
            for r in {math.floor(pos), math.ceil(pos)}:
                targets[(c, r)] = _Target(c, r, first[c].lo, first[c].hi, counts[c])

    while open_t := [t for t in targets.values() if t.value is None]:
        if trace is not None:
            trace.append(len(open_t))
        # Targets of one interval, in the first round all of a column, share a sketch.
        shared: dict[tuple, list[_Target]] = {}
        for t in open_t:
            shared.setdefault((t.column, t.lo, t.hi), []).append(t)
        # Rows in no interval, after the first round nearly all, reach no sketch.
        near = base.where(reduce(or_, [ts[0].inside() for ts in shared.values()]))
        brackets = near.agg(*[F.percentile_approx(F.when(ts[0].inside(), F.col(ts[0].column)), [p for t in ts for p in t.around(accuracy)], accuracy).alias(f"t{i}")
                              for i, ts in enumerate(shared.values())]).first()
        # A counted value serves every target of its column; an aggregate per
        # column, all in one job, stays small enough to be compiled.
        asked: dict[str, set[float]] = {}
        for ts, found in zip(shared.values(), brackets):
            asked.setdefault(ts[0].column, set()).update(found, [t.middle() for t in ts])
        asked = {c: sorted(xs) for c, xs in asked.items()}
        exact = reduce(DataFrame.union, [
            base.agg(F.lit(c), F.array(*[F.struct(F.count_if(F.col(c) <= F.lit(x)), F.count_if(F.col(c) < F.lit(x))) for x in xs]))
            for c, xs in asked.items()]).collect()
        for c, at in exact:
            for x, (le, lt) in zip(asked[c], at):
                for t in open_t:
                    if t.column == c:
                        t.learn(x, le, lt)
    value = {key: t.value for key, t in targets.items()}

    out = {}
    for c in cols:
        n = counts[c]
        res = []
        for p in spec[c]:
            if n == 0:
                res.append(None)
                continue
            pos = p * (n - 1)
            lo_v, hi_v = value[(c, math.floor(pos))], value[(c, math.ceil(pos))]
            frac = pos - math.floor(pos)
            res.append(lo_v + (hi_v - lo_v) * frac)
        out[c] = res
    return out


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: list[float]) -> list[float | None]:
    """Quantiles of ``value`` with each row counted ``weight`` (a whole
    number) times, linear interpolation.  Rows are range-partitioned and
    sorted by value; running weights add a partition's offset (one row per
    partition) to a window inside the partition, so no task holds all."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(
        F.col(value).cast("double").alias("_v"), F.col(weight).cast("long").alias("_w"))
    # Range bounds are sampled per evaluation, so the dealt rows are written.
    dealt = cut_lineage(rows.repartitionByRange("_v").sortWithinPartitions("_v").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    total = sums.agg(F.sum("_s")).first()[0]
    if not total:
        return [None] * len(probs)
    run = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(F.broadcast(offsets), "_part").select("_v", "_w", (F.col("_o") + F.sum("_w").over(run)).alias("_hi"))
    ranks = sorted({r for p in probs for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
    at = ranked.agg(*[F.max(F.when((F.col("_hi") - F.col("_w") <= r) & (F.col("_hi") > r), F.col("_v"))).alias(f"r{r}")
                      for r in ranks]).first()
    out = []
    for p in probs:
        pos = p * (total - 1)
        low, high = at[f"r{math.floor(pos)}"], at[f"r{math.ceil(pos)}"]
        out.append(low + (high - low) * (pos - math.floor(pos)))
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                      names: list[str] | None = None) -> DataFrame:
    """Exact per-group quantiles (linear interpolation) that hold no group
    in one task: (group, value) counts are pre-aggregated map-side, the
    distinct values are dealt by ranges of (group, value), and a group that
    spans partitions gets its ranks from running sums inside each and one
    row per (partition, group) for what comes before; the values at ranks
    floor / ceil of p·(n − 1) are picked by a grouped aggregate.  Returns one
    row per group with ``n`` and one column per quantile."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    x = F.col(value).cast("double")
    vc = (df.where(x.isNotNull()).groupBy(*keys, x.alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    vc = cut_lineage(vc.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = vc.groupBy("_part", *keys).agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"),
                       F.sum("_s").over(group).alias("_n"))
    run = Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("v._part") == F.col("s._part")
    for k in keys:
        same = same & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
    vc = (vc.withColumn("_run", F.sum("_c").over(run)).alias("v").join(sums.alias("s"), same)
          .select(*[F.col(f"v.{k}").alias(k) for k in keys], "_v", "_c", "_n", (F.col("_o") + F.col("_run")).alias("_hi")))
    lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")   # ranks [lo, hi) hold value _v
    aggs = [F.max("_n").alias("n")]
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        r0, r1 = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((lo <= r0) & (r0 < hi), F.col("_v"))).alias(f"_{name}_0"),
                 F.max(F.when((lo <= r1) & (r1 < hi), F.col("_v"))).alias(f"_{name}_1"),
                 F.max(pos).alias(f"_{name}_p")]
    g = vc.groupBy(*keys).agg(*aggs)

    def interp(nm):
        # (ceil − pos)·lower + (pos − floor)·upper, the form ``percentile``
        # uses, so both give the same bits.
        v0, v1, p_ = F.col(f"_{nm}_0"), F.col(f"_{nm}_1"), F.col(f"_{nm}_p")
        return (F.when(v0 == v1, v0)
                 .otherwise((F.ceil(p_) - p_) * v0 + (p_ - F.floor(p_)) * v1).alias(nm))
    return g.select(*keys, "n", *[interp(nm) for nm in names])


def grouped_quantile_columns(df: DataFrame, keys: list[str], columns: list[str], p: float = 0.5,
                             names: list[str] | None = None) -> DataFrame:
    """``grouped_quantiles`` for several columns at once: every row is
    exploded into one (column id, value) record per column, so one scan,
    one pre-aggregation and one ranking window serve all columns; the result
    is pivoted back to one row per group (fixed column list)."""
    names = names or [f"{c}_q" for c in columns]
    recs = F.array(*[F.struct(F.lit(i).alias("_k"), F.col(c).cast("double").alias("_x"))
                     for i, c in enumerate(columns)])
    long = df.select(*keys, F.explode(recs).alias("_r")).select(*keys, "_r._k", "_r._x")
    q = grouped_quantiles(long, [*keys, "_k"], "_x", [p], ["_q"])
    wide = q.groupBy(*keys).pivot("_k", list(range(len(columns)))).agg(F.first("_q"))
    return wide.select(*keys, *[F.col(str(i)).alias(n) for i, n in enumerate(names)])
