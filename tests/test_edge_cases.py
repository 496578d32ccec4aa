"""Edge frames of FIXTURES.md §5, each against its expected result."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from retail_signal.functions import aggs, scalar
from retail_signal.operators import clean, profile, series, temporal

D = dt.date


def approx(a, b, tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def test_calendar_lag_exact_day(spark):
    df = spark.createDataFrame([(1, D(2021, 1, 1), 10.0), (1, D(2021, 1, 2), 8.0),
                                (1, D(2021, 1, 5), 5.0)], "store long, date date, v double")
    out = (df.withColumn("dn", scalar.day_number("date"))
             .withColumn("lag1", temporal.calendar_lag("v", 1, temporal.series_window("store", "dn")))
             .orderBy("date").collect())
    assert [r.lag1 for r in out] == [None, 10.0, None]


def test_rolling_7d_sum_and_first_std(spark):
    rows = [(1, D(2021, 1, d), float(d)) for d in range(1, 10)]
    df = spark.createDataFrame(rows, "store long, date date, v double").withColumn("dn", scalar.day_number("date"))
    fr = temporal.rolling_frame(temporal.series_window("store", "dn"), 7)
    out = df.select("date", F.sum("v").over(fr).alias("s"), F.stddev_samp("v").over(fr).alias("sd")) \
            .orderBy("date").collect()
    assert [r.s for r in out] == [1, 3, 6, 10, 15, 21, 28, 35, 42]
    assert out[0].sd is None


def test_null_comparison_flag(spark):
    df = spark.createDataFrame([(1.0, None)], "v double, lag double")
    assert df.select(scalar.flag(F.col("v") < F.col("lag")).alias("f")).first().f == 0


@pytest.mark.parametrize("values,skew,sem", [
    ([1.0, 2.0, 4.0], 0.9352195, 0.8819171),
    ([1.0, 2.0], None, 0.5),
    ([3.0, 3.0, 3.0], 0.0, 0.0),
    ([1.0], None, None),
])
def test_skew_and_sem(spark, values, skew, sem):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = df.agg(aggs.pd_skew("x").alias("skew"), aggs.pd_sem("x").alias("sem")).first()
    assert approx(r.skew, skew)
    assert approx(r.sem, sem)


def test_all_null_group(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "g int, x double")
    r = df.groupBy("g").agg(aggs.pd_sum("x").alias("s"), aggs.pd_mean("x").alias("m"),
                            aggs.pd_count("x").alias("c"), aggs.pd_nunique("x").alias("u")).first()
    assert (r.s, r.m, r.c, r.u) == (0, None, 0, 0)


def test_first_non_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "a")], "g int, o int, x string")
    assert df.groupBy("g").agg(aggs.first_non_null("x", "o").alias("f")).first().f == "a"


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 2.0)], "a double, b double")
    assert [r.q for r in df.select(scalar.safe_div("a", "b").alias("q")).collect()] == [None, -1.0]


def test_percent_change_forward_filled(spark):
    rows = [(1, D(2021, 1, i + 1), v) for i, v in enumerate([0.0, 5.0, None, 6.0])]
    df = spark.createDataFrame(rows, "store long, date date, v double")
    out = series.row_features(df, key="store", value="v").orderBy("date").collect()
    got = [r.sales_pct_change for r in out]
    assert got[0] is None and got[1] is None and approx(got[2], 0.0) and approx(got[3], 0.2)


def test_row_rolling_requires_full_window(spark):
    rows = [(1, D(2021, 1, i + 1), float(i + 1)) for i in range(8)]
    df = spark.createDataFrame(rows, "store long, date date, v double")
    out = series.row_features(df, key="store", value="v").orderBy("date").collect()
    assert all(r.sales_rolling_mean_7 is None for r in out[:6])
    assert approx(out[6].sales_rolling_mean_7, 4.0)
    assert approx(out[7].sales_rolling_std_7, 2.1602469)
    assert [r.sales_lag_1 for r in out[:3]] == [None, 1.0, 2.0]


def test_back_then_forward_fill(spark):
    rows = [(1, D(2021, 1, 1), None), (1, D(2021, 1, 2), 2.0), (1, D(2021, 1, 3), None),
            (2, D(2021, 1, 1), None)]
    df = spark.createDataFrame(rows, "store long, date date, x double")
    out = clean.fill_within(df, ["x"]).orderBy("store", "date").collect()
    assert [r.x for r in out] == [2.0, 2.0, 2.0, None]


def test_quantiles_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    q = df.select(F.percentile("x", F.array(F.lit(0.33), F.lit(0.66))).alias("q")).first().q
    assert approx(q[0], 1.99) and approx(q[1], 2.98)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 2]], "x double")
    out = profile.histogram(df, "x", bins=2).orderBy("bin").collect()
    assert [r["count"] for r in out] == [1, 3]


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (None, 9.0)], "a double, b double")
    out = {(r.col_a, r.col_b): r.value for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert approx(out[("a", "b")], 0.9819805)


def test_chi_square_3x2_and_single_level(spark):
    cells = [[1, 1], [0, 2], [1, 1]]
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(cells) for j, n in enumerate(row) for _ in range(n)]
    df = spark.createDataFrame(rows, "a string, b string")
    r = profile.cramers_v(df, "a", "b").first()
    assert approx(r.chi2, 1.5)
    assert approx(r.cramers_v, math.sqrt(1.5 / (6 * 1)))
    one = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    assert profile.cramers_v(one, "a", "b").first().cramers_v is None


def test_chi_square_2x2_yates(spark):
    # O = [[10, 20], [30, 40]]: E11 = 30·40/100 = 12, |O−E| = 2 → (1.5)² · Σ 1/E
    rows = ([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40)
    df = spark.createDataFrame(rows, "a string, b string")
    expected = 1.5 ** 2 * (1 / 12 + 1 / 18 + 1 / 28 + 1 / 42)
    assert approx(profile.cramers_v(df, "a", "b").first().chi2, expected)


def test_iso_week_and_weekday(spark):
    df = spark.createDataFrame([(D(2021, 1, 1),), (D(2024, 1, 7),)], "d date")
    out = df.select(scalar.week_of_year("d").alias("w"), scalar.day_of_week("d").alias("wd")).collect()
    assert out[0].w == 53 and out[1].wd == 6


def test_geo_text(spark):
    df = spark.createDataFrame([("{'type': 'Point', 'coordinates': [-93.6, 41.6]}",), (None,), ("garbage",)],
                               "t string")
    out = df.select(scalar.geo_lon("t").alias("lon"), scalar.geo_lat("t").alias("lat")).collect()
    assert (out[0].lon, out[0].lat) == (-93.6, 41.6)
    assert (out[1].lon, out[1].lat) == (None, None)
    assert (out[2].lon, out[2].lat) == (None, None)


def test_gap_fill(spark):
    df = spark.createDataFrame([(1, 1, D(2021, 1, 1), 1, 750, 5), (1, 1, D(2021, 1, 4), 1, 750, 7)],
                               "store long, itemno long, date date, pack int, bottle_volume_ml int, "
                               "sale_bottles long")
    out = series.fill_missing_dates(df).orderBy("date").collect()
    assert [r.sale_bottles for r in out] == [5, 0, 0, 7]
    assert [r.pack for r in out] == [1, 1, 1, 1]


@pytest.mark.parametrize("n", [59, 60, 61, 75])
def test_window_count(spark, n):
    rows = [(1, 1, D(2021, 1, 1) + dt.timedelta(days=i), 1, 750, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "store long, itemno long, date date, pack int, bottle_volume_ml int, "
                                     "sale_bottles long")
    out = series.supervised_windows(df)
    assert out.count() == max(0, n - 60)
    if n > 60:
        r = out.orderBy("i").first()
        assert len(r.x) == 30 and len(r.y) == 30


def test_days_since_last_purchase_and_single_row(spark):
    rows = [(1, D(2021, 1, 1), 1.0), (1, D(2021, 1, 2), 2.0), (1, D(2021, 1, 5), 3.0),
            (2, D(2021, 1, 3), 4.0)]
    df = spark.createDataFrame(rows, "store long, date date, sale_dollars double")
    out = temporal.temporal_features(df).orderBy("store", "date").collect()
    assert [r.days_since_last_purchase for r in out[:3]] == [None, 1, 3]
    single = out[3]
    assert single.sale_dollars_lag_1d is None
    assert single.avg_days_between_purchases_7D is None
    assert single.consecutive_decrease == 0


def test_union_by_name_missing_columns(spark, tmp_path):
    from retail_signal.sources import files
    a = spark.createDataFrame([(1, "x")], "store long, city string")
    b = spark.createDataFrame([(2,)], "store long")
    out = files.union_pages([a, b]).orderBy("store").collect()
    assert [(r.store, r.city) for r in out] == [(1, "x"), (2, None)]
    a.write.parquet(str(tmp_path / "page=0"))
    b.write.parquet(str(tmp_path / "page=1"))
    got = files.read_pages(spark, str(tmp_path)).orderBy("store").collect()
    assert [(r.store, r.city, r.page) for r in got] == [(1, "x", 0), (2, None, 1)]
