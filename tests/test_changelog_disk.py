"""Disk of the change log and of the stream that maintains store-days."""

from pyspark.sql import functions as F

from retail_signal.streaming import views
from retail_signal.streaming.changelog import ChangeLog


def _put(spark, log, epoch, rows):
    log.put(spark.createDataFrame(rows, log.schema), epoch)
    log.commit(epoch)


def test_newest_rows_and_keys_with_nulls(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"], "k long, v string, w double")
    _put(spark, log, 0, [(1, "a", 1.0), (None, "a", 1.0), (3, "a", None)])
    _put(spark, log, 1, [(1, "b", None), (2, "b", 2.0)])
    _put(spark, log, 2, [(2, None, None), (None, "c", 3.0)])
    wanted = {(1, "b", None), (None, "c", 3.0), (3, "a", None), (2, None, None)}
    assert {tuple(r) for r in log.read().collect()} == wanted
    assert sorted(log.read().columns) == ["k", "v", "w"] and log.read().count() == 4
    keys = log.read([])  # the keys alone, not all columns
    assert keys.columns == ["k"] and {r.k for r in keys.collect()} == {1, 2, 3, None} and keys.count() == 4
    assert log.compact()
    assert {tuple(r) for r in log.read().collect()} == wanted
    _put(spark, log, 3, [(3, "d", 4.0)])
    assert {tuple(r) for r in log.read(["w"]).collect()} == {(1, None), (None, 3.0), (3, 4.0), (2, None)}


def test_newest_part_is_not_exchanged(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"], "k long, v string")
    _put(spark, log, 0, [(i, "old" * 20) for i in range(50)])
    _put(spark, log, 1, [(i, "new" * 20) for i in range(50)])
    plan = log.read()._jdf.queryExecution().optimizedPlan().toString()
    newest, _, rest = plan.partition("Project")  # Union: the newest part, then what older ones have left
    assert "Window" not in newest and "Window" in rest
    snapshot = log.read()._jdf.queryExecution().executedPlan().toString()
    assert snapshot.count("Exchange") == 1


def test_view_deletes_what_its_snapshots_hold(spark, tmp_path):
    view = views.StoreDayView(spark, str(tmp_path / "view"), compact_every=2, keep=0)
    ddl = "store long, date date, itemno long, sale_bottles int, sale_dollars double, sale_liters double, sale_gallons double"
    rows = spark.range(40).select(F.expr("id % 3").alias("store"), F.expr("date_add(DATE'2020-01-01', cast(id as int))").alias("date"),
                                  F.col("id").alias("itemno"), *[F.col("id").cast(t).alias(c) for c, t in
                                                                 [("sale_bottles", "int"), ("sale_dollars", "double"), ("sale_liters", "double"), ("sale_gallons", "double")]])
    assert rows.schema.simpleString() == spark.createDataFrame([], ddl).schema.simpleString()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    for epoch in range(5):
        view.apply(rows.where(F.col("itemno") % 5 == epoch), epoch)
    assert spark.conf.get(name, None) == before
    for log in (view.states, view.features):
        assert len(log._files.names("snapshots")) == 1
        assert log._files.names("changes") == ["epoch=4"]
    assert view.store_day().count() == 40 and view.temporal().count() == 40
    assert {r.sale_dollars for r in view.store_day().collect()} == {float(i) for i in range(40)}
