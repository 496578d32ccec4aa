"""Plan-level operators: global index, multi-pair Cramér's V, sorted sink."""

import numpy as np
from pyspark.sql import functions as F

from retail_signal.operators.profile import cramers_v, cramers_v_pairs
from retail_signal.operators.rank import global_index


def test_global_index_dense_and_ordered(spark):
    rng = np.random.default_rng(3)
    # one key value holds a third of the rows; the tiebreak makes the order total
    keys = np.concatenate([np.full(300, 7), rng.integers(0, 50, 600)])
    rows = [(int(k), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(6)
    out = global_index(df, [F.col("k").asc(), F.col("id").desc()], "pos").collect()
    got = sorted((r.pos, r.k, -r.id) for r in out)
    assert [p for p, _, _ in got] == list(range(len(rows)))
    assert [(k, i) for _, k, i in got] == sorted((k, -i) for k, i in rows)


def test_cramers_pairs_equal_single_pair(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{x}", f"b{y}", int(z)) for x, y, z in zip(rng.integers(0, 4, 500),
                                                          rng.integers(0, 3, 500),
                                                          rng.integers(0, 2, 500))]
    df = spark.createDataFrame(rows, "a string, b string, c long")
    many = {(r.col_a, r.col_b): (r.chi2, r.cramers_v, r.n)
            for r in cramers_v_pairs(df, [("a", "b"), ("a", "c"), ("b", "c")]).collect()}
    for a, b in [("a", "b"), ("a", "c"), ("b", "c")]:
        one = cramers_v(df, a, b).first()
        assert np.isclose(many[(a, b)][0], one.chi2) and many[(a, b)][2] == one.n


def test_sorted_sink_orders_files(spark, tmp_path):
    from retail_signal.plans.pipeline import write_sorted
    import datetime as dt
    rows = [(s, dt.date(2021, 1, 1) + dt.timedelta(days=d)) for s in (1, 2, 3) for d in range(40)]
    rows += [(2, dt.date(2022, 1, 1) + dt.timedelta(days=d)) for d in range(200)]  # a large store
    df = spark.createDataFrame(rows, "store long, date date").repartition(5)
    write_sorted(df, str(tmp_path / "out"), partitions=4)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("f", F.input_file_name())
    files = back.groupBy("f").agg(F.min(F.struct("store", "date")).alias("lo"),
                                  F.max(F.struct("store", "date")).alias("hi")).orderBy("lo").collect()
    for x, y in zip(files, files[1:]):
        assert tuple(x.hi) <= tuple(y.lo)
    assert back.count() == len(rows)


def test_large_store_days_take_the_spill_safe_path_to_the_same_bits(spark):
    import datetime as dt
    from retail_signal.operators.aggregate import STORE_DAY_AGGS, store_day_aggregates
    rng = np.random.default_rng(4)
    columns = list(dict.fromkeys(c for c, _ in STORE_DAY_AGGS))
    rows = [(1 if i % 3 else int(rng.integers(2, 6)), dt.date(2021, 1, 1 + i % 2), *[float(x) for x in rng.integers(0, 50, len(columns))])
            for i in range(600)]
    df = spark.createDataFrame(rows, "store long, date date, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    plain, mixed, rank = (sorted(map(tuple, store_day_aggregates(df, **kw).select(
        "store", "date", *[f"{c}_median" for c, a in STORE_DAY_AGGS if "median" in a]).collect()))
        for kw in ({"median_method": "percentile"}, {"buffer_lines": 50}, {"median_method": "rank"}))
    assert plain == mixed == rank


def test_lists_give_what_the_separate_aggregates_give(spark):
    import datetime as dt
    from retail_signal.operators.aggregate import STORE_DAY_AGGS, store_day_aggregates
    rng = np.random.default_rng(8)
    columns = list(dict.fromkeys(c for c, _ in STORE_DAY_AGGS))
    whole = {"sale_bottles", "pack", "bottle_volume_ml", "itemno", "category"}
    rows = []
    for i in range(500):
        store = int(rng.integers(1, 60)) if i % 4 else 1
        values = [None if rng.random() < 0.15 else (int(rng.integers(-3, 9)) if c in whole else str(int(rng.integers(0, 9))) if c in ("invoice_line_no", "category_name")
                  else float(rng.choice([0.1, 0.3, float(rng.normal())]))) for c in columns]
        rows.append((store, dt.date(2021, 1, 1 + i % 3), *values, f"im{i % 4}"))
    rows += [(99, dt.date(2021, 1, 1), *[None] * (len(columns) + 1)), (None, dt.date(2021, 1, 1), *[None] * (len(columns) + 1))]
    ddl = "store long, date date, " + ", ".join(
        f"{c} {'int' if c in whole else 'string' if c in ('invoice_line_no', 'category_name') else 'double'}" for c in columns) + ", im_desc string"
    df = spark.createDataFrame(rows, ddl).repartition(5)
    lists, split, separate = (store_day_aggregates(df, with_items=True, **kw) for kw in ({}, {"buffer_lines": 20}, {"median_method": "percentile"}))
    assert lists.dtypes == split.dtypes == separate.dtypes

    def table(d):
        return {(r.store, r.date): [round(v, 9) + 0.0 if isinstance(v, float) else v for v in r] for r in d.collect()}
    a, b, c = table(lists), table(split), table(separate)
    assert a.keys() == b.keys() == c.keys() and (99, dt.date(2021, 1, 1)) in a
    for k in c:
        for x, y, z in zip(a[k], b[k], c[k]):
            assert x == y == z or abs(x - z) < 1e-8 and abs(y - z) < 1e-8, k


def test_few_lines_a_day_need_one_exchange(spark):
    from retail_signal.operators.aggregate import prepared_lines, store_day_aggregates
    from retail_signal.plans.registry import sales
    lines = prepared_lines(sales(spark, "/root/testdata/sf0.001"))
    plan = store_day_aggregates(lines, with_items=True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_store_day_reads_the_lines_once(spark):
    from retail_signal.operators.aggregate import prepared_lines, store_day
    from retail_signal.plans.registry import sales
    lines = prepared_lines(sales(spark, "/root/testdata/sf0.001"))
    plan = store_day(lines, with_item_details=False)._jdf.queryExecution().toString()
    assert "lineitem" not in plan


def test_windows_of_any_horizon_and_split_without_moving_arrays(spark):
    import datetime as dt
    from retail_signal.operators import evaluate as ev
    from retail_signal.operators import series as se
    rows = [(s, k, dt.date(2021, 1, 1) + dt.timedelta(days=d), float(d % 7 + 1), 1.0, 750.0)
            for s in (1, 2) for k in (5, 6) for d in range(30 + 10 * s)]
    df = spark.createDataFrame(rows, "store long, itemno long, date date, sale_bottles double, pack double, bottle_volume_ml double")
    w = se.supervised_windows(df, seq_len=10, horizon=5)
    split = se.chronological_split(w).collect()
    order = sorted(split, key=lambda r: (r.store, r.itemno, r.i))
    assert [r.sample_index for r in order] == list(range(len(order)))
    assert sum(r.split == "train" for r in order) == int(len(order) * 0.8)
    pred = ev.baseline_predictions(w).where("model = 'seasonal_naive'").collect()
    x = {(r.store, r.itemno, r.i): [v.sale_bottles for v in r.x] for r in w.collect()}
    assert all(r.y_hat == x[r.store, r.itemno, r.i][5 + r.step] for r in pred) and {r.step for r in pred} == set(range(5))
    longer = se.supervised_windows(df, seq_len=3, horizon=7)  # repeats the few inputs
    assert ev.baseline_predictions(longer).where("y_hat is null").count() == 0


def test_marginals_and_hot_groups(spark):
    """One value of a column holds a third of the rows."""
    from retail_signal.operators.quantile import grouped_quantiles
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: (r.n, r.q50) for r in grouped_quantiles(df, ["g"], "x", [0.5]).collect()}
    for g in {r[0] for r in rows}:
        values = [x for k, x in rows if k == g]
        assert got[g][0] == len(values) and np.isclose(got[g][1], np.median(values))
