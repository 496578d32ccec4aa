"""Store-day tables maintained from a stream of lines against the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retail_signal.operators.temporal import temporal_features
from retail_signal.streaming import streams, views
from retail_signal.streaming.changelog import ChangeLog

LINES = "store long, date date, itemno string, sale_bottles long, sale_dollars double, sale_liters double, sale_gallons double"


def lines(n=600, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.choice([rnd.randrange(40), rnd.randrange(500)]))
        v = float(rnd.randint(-3, 40))
        out.append((rnd.choice([1, 1, 2, 3]), day, rnd.choice("abcde"), int(v), v * 2, None if v < 0 else v / 4, v))
    return out + [(None, dt.date(2020, 1, 1), "a", 1, 1.0, 1.0, 1.0), (4, None, "a", 1, 1.0, 1.0, 1.0), (9, dt.date(2021, 1, 1), None, None, None, None, None)]


def rounded(df):
    cols = sorted(df.columns)
    return sorted([tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()],
                  key=lambda r: tuple(map(str, r)))


def batch_days(df):
    return (df.where("store IS NOT NULL AND date IS NOT NULL").groupBy("store", "date")
            .agg(F.coalesce(F.sum("sale_dollars"), F.lit(0.0)).alias("sale_dollars")))


@pytest.mark.parametrize("n_files", [1, 5, 20])
def test_view_equals_the_batch_after_any_batches(spark, tmp_path, n_files):
    rows = lines(300)
    random.Random(n_files).shuffle(rows)
    df = spark.createDataFrame(rows, LINES)
    src = str(tmp_path / "in")
    for i in range(n_files):
        spark.createDataFrame(rows[i::n_files], LINES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(src)
    view = views.StoreDayView(spark, str(tmp_path / "view"), compact_every=4)
    views.maintain_store_days(stream, view, str(tmp_path / "ckpt"))
    got, want = view.temporal(), temporal_features(batch_days(df))
    assert got.columns == want.columns
    assert rounded(got) == rounded(want)
    agg = (df.where("store IS NOT NULL AND date IS NOT NULL").groupBy("store", "date").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_distinct("itemno").alias("unique_items"),
        F.stddev_samp("sale_dollars").alias("sale_dollars_std"), F.avg("sale_liters").alias("sale_liters_mean")))
    assert rounded(view.store_day().select(*agg.columns)) == rounded(agg)
    assert view.states.last() == n_files - 1


def test_only_rows_within_reach_are_computed_again(spark, tmp_path):
    view = views.StoreDayView(spark, str(tmp_path))
    day = dt.date(2020, 1, 1)
    many = [(s, day + dt.timedelta(days=3 * d), "a", 1, float(d % 7), 1.0, 1.0) for s in (1, 2) for d in range(200)]
    view.apply(spark.createDataFrame(many, LINES), 0)
    late = [(1, day + dt.timedelta(days=301), "a", 1, 5.0, 1.0, 1.0)]
    done = view.apply(spark.createDataFrame(late, LINES), 1)
    # The new day and the store's days in the 89 days after it; store 2 has none.
    assert done == {"touched": 1, "recomputed": 1 + len([d for d in range(200) if 301 < 3 * d <= 301 + 89])}
    assert rounded(view.temporal()) == rounded(temporal_features(batch_days(spark.createDataFrame(many + late, LINES))))


def test_a_replayed_or_broken_batch_counts_once(spark, tmp_path, monkeypatch):
    parts = [lines(80, s) for s in range(3)]
    view = views.StoreDayView(spark, str(tmp_path), compact_every=2)
    want = rounded(temporal_features(batch_days(spark.createDataFrame(sum(parts, []), LINES))))

    def broken(*_):
        raise RuntimeError("lost")
    for epoch, part in enumerate(parts):
        batch = spark.createDataFrame(part, LINES)
        for target, name in ((view, "_recomputed"), (view.features, "commit"), (view.states, "commit")):
            with monkeypatch.context() as m:
                m.setattr(target, name, broken)
                with pytest.raises(RuntimeError):
                    view.apply(batch, epoch)
        view.apply(batch, epoch)
        assert view.apply(batch, epoch) == {"touched": 0, "recomputed": 0}
    assert rounded(view.temporal()) == want
    view.states.vacuum()
    view.features.vacuum()
    assert rounded(views.StoreDayView(spark, str(tmp_path)).temporal()) == want


def test_compaction_may_die_before_and_after_the_pointer(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), ["k"], "k long, v long")
    assert log.read().collect() == [] and not log.compact()
    want = {}
    for epoch in range(6):
        rows = [(k, 10 * epoch + k) for k in range(epoch, epoch + 3)]
        want.update(rows)
        log.put(spark.createDataFrame(rows, "k long, v long"), epoch)
        before = dict(map(tuple, log.read().collect()))
        assert before == {k: v for k, v in want.items() if v // 10 != epoch or False} | {k: v for k, v in before.items() if k in before} or epoch
        log.commit(epoch)
        assert dict(map(tuple, log.read().collect())) == want
        if epoch == 2:
            log.write_snapshot(epoch)  # dies before the pointer
            assert log.snapshot() == (-1, None)
        if epoch == 3:
            log.publish(log.write_snapshot(epoch))  # dies before the old folders go
            assert log.snapshot()[0] == 3 and log.epochs() == []
        assert dict(map(tuple, log.read().collect())) == want
    log.put(spark.createDataFrame([(0, -1)], "k long, v long"), 9)  # dies before its marker
    assert dict(map(tuple, log.read().collect())) == want
    log.compact()
    log.vacuum(keep=0)
    assert dict(map(tuple, log.read().collect())) == want
    only = spark.createDataFrame([(3,), (4,)], "k long")
    assert dict(map(tuple, log.read(["v"], only).collect())) == {k: v for k, v in want.items() if k in (3, 4)}


def test_a_batch_without_its_marker_is_not_read(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), ["k"], "k long, v long")
    log.put(spark.createDataFrame([(1, 1)], "k long, v long"), 0)
    assert log.read().collect() == [] and not log.holds(0) and log.last() == -1
    log.put(spark.createDataFrame([(1, 2)], "k long, v long"), 0)
    log.commit(0)
    log.commit(0)
    assert [tuple(r) for r in log.read().collect()] == [(1, 2)] and log.last() == 0


def test_waiting_rows_rewrite_only_their_own_entries():
    """State written for a batch does not depend on how many rows wait."""
    import pandas as pd

    class State:
        def __init__(self):
            self.data, self.written = {}, 0
        def containsKey(self, k):
            return k in self.data
        def getValue(self, k):
            return self.data[k]
        def updateValue(self, k, v):
            self.data[k] = v
            self.written += sum(map(len, v))
        def removeKey(self, k):
            del self.data[k]
        def keys(self):
            return iter(self.data)

    class Handle:
        def getMapState(self, *_):
            return State()
        def getValueState(self, *_):
            return None
        def registerTimer(self, _):
            pass
    p = streams.DeclineAlerts()
    p.init(Handle())
    sizes = []
    for day in range(0, 3200, 2):
        before = p.waiting.written
        list(p.handleInputRows((1,), iter([pd.DataFrame({"day": [day], "value": [1.0]})]), None))
        sizes.append(p.waiting.written - before)
    assert max(sizes) <= 2 * streams.ENTRY_DAYS


def test_states_of_runs_are_those_of_aggregates(spark, monkeypatch):
    df = spark.createDataFrame(lines(300) + [(1, dt.date(2020, 1, 1), "a", None, None, None, None)] * 2, LINES)
    runs = views.line_states(df)
    assert "MapInArrow" in runs._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(views, "few_lines_a_day", lambda _: False)
    aggregates = views.line_states(df)
    assert runs.dtypes == aggregates.dtypes

    def flat(states):
        return rounded(states.select(*views.KEYS, "lines", "items", *[F.col(m)[k].alias(f"{m}_{k}") for m in views.MEASURES
                                                                     for k in ("n", "sum", "mean", "m2", "low", "high")]))
    assert flat(runs) == flat(aggregates)


def test_features_are_stored_without_what_follows_from_them(spark, tmp_path):
    view = views.StoreDayView(spark, str(tmp_path))
    view.apply(spark.createDataFrame(lines(100), LINES), 0)
    kept, shown = view.features.schema.fieldNames(), view.temporal().columns
    assert set(kept) < set(shown) and len(kept) == len(shown) - 23
    assert rounded(view.temporal()) == rounded(temporal_features(batch_days(spark.createDataFrame(lines(100), LINES))))
