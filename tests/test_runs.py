"""Store-days measured as runs of sorted lines."""

from pyspark.sql import functions as F

from retail_signal.operators import aggregate as agg

COLUMNS = ["invoice_line_no", "category", "category_name", "itemno"]
NAMES = [agg.agg_name(c, "nunique") for c in COLUMNS]


def _lines(spark, n=3000):
    """Store-days of 1 to some hundred lines, with NULLs and repeated values."""
    numbers = [c for c, _ in agg.STORE_DAY_AGGS if c not in COLUMNS]
    made = {"store": F.expr("case when id % 3 = 0 then 1 when id % 101 = 0 then null else id % 400 end"),
            "date": F.expr("date_add(DATE'2020-01-01', cast(case when id % 3 = 0 then 0 else id % 7 end as int))"),
            "invoice_line_no": F.expr("if(id % 13 = 0, null, concat('INV-', id % 1000))"),
            "category": F.expr("if(id % 5 = 0, null, id % 6)"), "category_name": F.expr("concat('c', id % 4)"),
            "itemno": F.expr("if(id % 400 = 7, null, id % 37)")}
    ints = {"sale_bottles", "pack", "bottle_volume_ml"}
    made |= {c: F.expr(f"if(id % {7 + i} = 0, null, id % {11 + i} - 3)").cast("int" if c in ints else "double")
             for i, c in enumerate(numbers)}
    return spark.range(0, n, 1, 5).select(*[c.alias(k) for k, c in made.items()])


def _rows(df):
    return sorted(map(str, df.collect()))


def test_distinct_counts_move_each_line_once(spark):
    lines = _lines(spark)
    expected = _rows(agg.valid_lines(lines).groupBy(*agg.KEYS).agg(
        *[F.count_distinct(c).alias(n) for c, n in zip(COLUMNS, NAMES)]))
    assert _rows(agg.store_day_some(lines, NAMES)) == expected
    plan = agg.store_day_some(lines, NAMES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_distinct_counts_of_large_store_days_are_not_held(spark):
    lines = _lines(spark)
    expected = _rows(agg.store_day_some(lines, NAMES, buffer_lines=10 ** 6))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 64):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            split = agg.store_day_some(lines, NAMES, buffer_lines=20)
            assert "Expand" in split._jdf.queryExecution().optimizedPlan().toString()
            assert _rows(split) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_store_day_aggregates_need_no_lists(spark):
    lines = _lines(spark)
    made = agg.store_day_aggregates(lines)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    names = made.columns
    assert _rows(made) == _rows(agg._from_lists(agg.valid_lines(lines), False).select(names))


def test_run_measures_do_not_depend_on_batches(spark):
    lines = _lines(spark, 600)
    expected = _rows(agg.store_day_aggregates(lines))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert _rows(agg.store_day_aggregates(lines)) == expected
        assert _rows(agg.store_day_aggregates(lines.limit(0))) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
