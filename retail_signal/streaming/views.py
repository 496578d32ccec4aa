"""Store-day tables kept up to date as invoice lines arrive (J2 with I1 / I3).

``StoreDayView`` holds two keyed change logs.

``states``: one row per (store, date) with what merges: line count, per measure
count, sum, mean, second central moment, least and greatest value, and the set
of items.  A batch's lines are reduced to such states and merged with the old
state of the touched keys only (Chan's update for the moments), so days may
come in any order, late and in pieces.

``features``: the calendar lags, 7–90-day frames, momentum and decline flags of
``temporal_features``.  A row changes when a day within its longest frame
before it changes, or one of the two rows before it does.  Only those rows are
computed again, from those rows and the ones their own frames read.  What
depends on a whole series, the mean gap between purchases, comes from one row
per store when the view is read; momentum, flags and cyclic codes, which follow
from a row's own lags and frames, are worked out then too.

A batch is applied once: it is committed in both logs after both are written,
and a replayed one that is committed already is left out.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import day_number, safe_div
from ..operators.aggregate import KEYS, few_lines_a_day, valid_lines
from ..operators.runs import measure_runs
from ..operators.temporal import DN, LAG_DAYS, ROLLING_DAYS, derived_features, temporal_features
from ..session import cut_lineage
from .changelog import ChangeLog

MEASURES = ["sale_bottles", "sale_dollars", "sale_liters", "sale_gallons"]
TARGET = "sale_dollars"
#: Days that a change reaches forward: the longest frame or lag.
REACH = max(*[d - 1 for d in ROLLING_DAYS], *LAG_DAYS)
GAPS = [f"avg_days_between_purchases_{d}D" for d in ROLLING_DAYS]
#: What the log of features keeps of a row; the rest follows from it.
STORED = [*KEYS, TARGET, *[f"{TARGET}_lag_{k}d" for k in LAG_DAYS],
          *[f"{TARGET}_rolling_{kind}_{d}D" for d in ROLLING_DAYS for kind in ("mean", "std", "max", "min", "median")],
          "days_since_last_purchase", "consecutive_decrease"]

_MOMENTS = "struct<n:bigint,sum:double,mean:double,m2:double,low:double,high:double>"
STATE_DDL = "store long, date date, lines long, " + ", ".join(f"{m} {_MOMENTS}" for m in MEASURES) + ", items array<string>"


def line_states(lines: DataFrame) -> DataFrame:
    """Mergeable states of the (store, date) of ``lines``: runs of lines dealt
    by store-day (a batch may come in few files), or aggregates where a
    store-day has too many lines to be held."""
    lines = valid_lines(lines).select(*KEYS, *MEASURES, F.col("itemno").cast("string").alias("itemno"))
    if few_lines_a_day(lines):
        return _run_states(lines)

    def moments(c):
        x = F.col(c).cast("double")
        n = F.count(x)
        return F.struct(n.alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.avg(x).alias("mean"),
                        F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high")).alias(c)
    items = F.array_sort(F.collect_set("itemno")).alias("items")
    return (lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("lines"), *[moments(c) for c in MEASURES], items)
            .select(F.col("store").cast("long"), "date", "lines", *MEASURES, "items"))


def _run_states(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.col("store").cast("long").alias("store"), "date", F.lit(True).alias("line"),
                        *[F.col(c).cast("double").alias(c) for c in MEASURES], "itemno")
    runs = measure_runs(rows, KEYS, {c: 2 for c in MEASURES}, ["line"], records=["itemno"])

    def moments(c):
        n, total = F.col(f"_n_{c}"), F.col(f"_s_{c}")
        return F.struct(n.alias("n"), total.alias("sum"), F.try_divide(total, n.cast("double")).alias("mean"),
                        F.coalesce(F.col(f"_m2_{c}"), F.lit(0.0)).alias("m2"), F.col(f"_a_{c}").alias("low"), F.col(f"_z_{c}").alias("high")).alias(c)
    items = F.filter(F.transform("_records", lambda r: r["itemno"]), lambda i: i.isNotNull()).alias("items")
    return runs.select(*KEYS, F.col("_n_line").alias("lines"), *[moments(c) for c in MEASURES], items)


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """The states of the keys of ``new``, merged with ``old``."""
    both = new.alias("b").join(old.alias("a"), KEYS, "left")

    def merged(c):
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        an, bn = F.coalesce(a["n"], F.lit(0)), b["n"]
        n = an + bn
        am, bm = F.coalesce(a["mean"], F.lit(0.0)), F.coalesce(b["mean"], F.lit(0.0))
        gap = bm - am
        return F.struct(n.alias("n"), (F.coalesce(a["sum"], F.lit(0.0)) + b["sum"]).alias("sum"),
                        F.when(n > 0, am + gap * bn / n).alias("mean"),
                        F.when(n > 0, F.coalesce(a["m2"], F.lit(0.0)) + b["m2"] + gap * gap * an * bn / n).otherwise(F.lit(0.0)).alias("m2"),
                        F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high")).alias(c)
    items = F.array_sort(F.array_union(F.coalesce(F.col("a.items"), F.array().cast("array<string>")), F.col("b.items"))).alias("items")
    return both.select(*KEYS, (F.coalesce(F.col("a.lines"), F.lit(0)) + F.col("b.lines")).alias("lines"),
                       *[merged(c) for c in MEASURES], items)


def store_days(states: DataFrame) -> DataFrame:
    """The store-day table that the states stand for."""
    cols = [F.col("lines").alias("transaction_count"), F.size("items").cast("long").alias("unique_items")]
    for c in MEASURES:
        n = F.col(c)["n"]
        cols += [F.col(c)["sum"].alias(c), F.col(c)["mean"].alias(f"{c}_mean"),
                 F.when(n > 1, F.sqrt(F.col(c)["m2"] / (n - 1))).alias(f"{c}_std"),
                 F.col(c)["low"].alias(f"{c}_min"), F.col(c)["high"].alias(f"{c}_max")]
    return states.select(*KEYS, *cols)


def affected_rows(days: DataFrame, reach: int = REACH) -> DataFrame:
    """``days`` (store, date, …, touched) reduced to what a recomputation
    reads, with ``affected``: 1 where the features may change."""
    w = Window.partitionBy("store").orderBy(DN)
    hit = F.greatest(F.max("touched").over(w.rangeBetween(-reach, 0)), F.max("touched").over(w.rowsBetween(-2, 0)))
    marked = days.withColumn(DN, day_number("date")).withColumn("affected", hit)
    read = F.greatest(F.max("affected").over(w.rangeBetween(0, reach)), F.max("affected").over(w.rowsBetween(0, 2)))
    return marked.withColumn("_read", read).where("_read = 1").drop("_read", DN)


@contextmanager
def shuffle_cleanup(*sessions: SparkSession):
    """Jobs inside delete their shuffle files when they end, not when the
    driver collects garbage: a stream runs many that write wide tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [(s, s.conf.get(name, None)) for s in sessions]
    for s in sessions:
        s.conf.set(name, "true")
    try:
        yield
    finally:
        for s, value in reversed(before):
            s.conf.set(name, value) if value else s.conf.unset(name)


class StoreDayView:
    """Incremental store-day states and temporal features under ``path``.
    ``keep``: after a compaction, what the snapshots hold is deleted but for
    so many older snapshots (None: nothing, for readers of any age)."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16, keep: int | None = None):
        self.spark, self.compact_every, self.keep = spark, compact_every, keep
        self.states = ChangeLog(spark, f"{path}/states", KEYS, STATE_DDL)
        empty = spark.createDataFrame([], f"store long, date date, {TARGET} double")
        self.schema: StructType = temporal_features(empty).schema
        self.features = ChangeLog(spark, f"{path}/features", KEYS, temporal_features(empty).select(*STORED).schema)

    def apply(self, lines: DataFrame, epoch: int) -> dict[str, int]:
        """Apply batch ``epoch``; a second time changes nothing.  Returns how
        many days were touched and how many feature rows computed again."""
        with shuffle_cleanup(self.spark, lines.sparkSession):
            return self._apply(lines, epoch)

    def _apply(self, lines: DataFrame, epoch: int) -> dict[str, int]:
        done = {"touched": 0, "recomputed": 0}
        if self.states.holds(epoch) and self.features.holds(epoch):
            return done
        if not self.states.holds(epoch):
            new = cut_lineage(line_states(lines))
            self.states.put(merge_states(self.states.read(only=new.select(*KEYS)), new), epoch)
        part = self.spark.read.schema(self.states.schema).parquet(f"{self.states.path}/changes/epoch={epoch}")
        done["touched"] = part.count()
        if not self.features.holds(epoch):
            changed = self._recomputed(part)
            self.features.put(changed, epoch)
            done["recomputed"] = self.spark.read.parquet(f"{self.features.path}/changes/epoch={epoch}").count()
            self.features.commit(epoch)
        if not self.states.holds(epoch):
            self.states.commit(epoch)
        if len(self.states.epochs()) >= self.compact_every:
            for log in (self.states, self.features):
                log.compact()
                if self.keep is not None:
                    log.vacuum(self.keep)
        return done

    def _recomputed(self, part: DataFrame) -> DataFrame:
        """Feature rows that the days of ``part`` change, from the states of
        the touched stores alone."""
        stores = part.select("store").distinct()
        days = self.states.read([TARGET], stores, part).select(*KEYS, F.col(TARGET)["sum"].alias(TARGET))
        touched = part.select(*KEYS, F.lit(1).alias("touched"))
        days = days.join(touched, KEYS, "left").withColumn("touched", F.coalesce("touched", F.lit(0)))
        # The windows of affected_rows leave the rows dealt by store and in order.
        needed = affected_rows(days).select(*KEYS, TARGET, "affected")
        return temporal_features(needed, method="runs", dealt=True).where("affected = 1").select(*self.features.schema.fieldNames())

    def store_day(self) -> DataFrame:
        return store_days(self.states.read())

    def temporal(self) -> DataFrame:
        """The view: what ``temporal_features`` gives over all lines so far."""
        span = F.datediff(F.max("date"), F.min("date"))
        # From the keys alone and written: its size is known, so the wide rows
        # are not dealt by store for it.
        gap = cut_lineage(self.features.read([]).groupBy("store").agg(safe_div(span, F.count(F.lit(1)) - 1).alias("_gap")))
        out = self.features.read().join(gap, "store").withColumns({c: F.col("_gap") for c in GAPS})
        return derived_features(out, F.col("days_since_last_purchase"), F.col("consecutive_decrease")).select(*self.schema.fieldNames())


def maintain_store_days(stream: DataFrame, view: StoreDayView, checkpoint: str, available_now: bool = True):
    """Run ``stream`` (invoice lines) into ``view``, one batch an epoch."""
    def apply(batch: DataFrame, epoch: int) -> None:
        view.apply(batch, epoch)

    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
