"""Every registered query against its DuckDB twin on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import os
import re

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

SF = os.environ.get("RETAIL_SIGNAL_TEST_SF", "/root/testdata/sf0.001")
#: The optional training-data queries have tests of their own.
QUERIES = {n: q for n, q in E.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
SQLS = {n: s for n, s in E.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duck(SF)
    yield c
    c.close()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "sale_dollars_rolling_mean_30D" in df.columns
    assert df.count() > 0


def test_every_query_has_a_builder():
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], SQLS.get(name), SF)
    if name in SQLS:
        assert res["ok"], res
    else:
        assert res["rows"] > 0


@pytest.mark.parametrize("name", ["d12_store_day_aggregates", "i05_clean"])
def test_sums_match_on_more_rows(spark, name):
    """More rows hold more sums that lie close to a rounding tie."""
    big = SF.replace("sf0.001", "sf0.01")
    res = compare(spark, duck(big), name, QUERIES[name], SQLS[name], big)
    assert res["ok"], res
