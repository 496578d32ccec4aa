"""The wide table of I4 / I6 is written once, and rounded without detours."""

import datetime as dt
import random

from pyspark.sql import functions as F

from retail_signal.functions import scalar
from retail_signal.plans import pipeline, q_pipeline
from retail_signal.sources.files import SALES_SCHEMA


def test_round_double_gives_the_bits_of_round(spark):
    rnd = random.Random(3)
    xs = [0.0, -0.0, 1e-10, 5e-10, -5e-10, 1.5e-9, 2.5e-9, 0.1, 1e5, 123456.7, 1e15, -1e300, 1e308, float("nan"), float("inf"), None]
    for _ in range(4000):
        x = rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randint(-12, 9)
        xs += [x, round(x, 9), round(x, 2), (round(x * 1e9) + 0.5) / 1e9, x / 3]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    bits = df.select(scalar.round_double(F.col("x"), 9).alias("a"), F.round("x", 9).alias("b")).collect()
    assert [repr(r.a) for r in bits] == [repr(r.b) for r in bits]


def _lines(spark):
    rnd, rows = random.Random(5), []
    for i in range(60):
        rows.append({"invoice_line_no": f"L{i}", "date": dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(30)),
                     "store": rnd.choice([1, 2, 3]), "city": "c", "county": None, "itemno": rnd.randrange(5), "pack": 6,
                     "sale_bottles": rnd.randrange(-2, 9), "sale_dollars": float(rnd.randrange(50)), "sale_liters": 1.0})
    names = SALES_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SALES_SCHEMA)


def test_rolling_columns_are_written_once(spark, monkeypatch):
    """I6 writes them once, after the store features; I4 not at all."""
    written, real = [], pipeline.cut_lineage

    def counted(df):
        written.append("sale_dollars_rolling_mean_7D" in df.columns)
        return real(df)
    monkeypatch.setattr(pipeline, "cut_lineage", counted)
    monkeypatch.setattr(q_pipeline, "cut_lineage", counted, raising=False)
    monkeypatch.setattr(q_pipeline, "sales", lambda spark, _: _lines(spark))
    assert q_pipeline.i06_feature_job(spark, "").count() > 20
    assert sum(written) == 1
    written.clear()
    assert q_pipeline.i04_store_features(spark, "").count() > 20
    assert sum(written) == 0
