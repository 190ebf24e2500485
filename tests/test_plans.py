"""Every registered query against its oracle, and the shape of its plan."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
import check_oracles  # noqa: E402
from ledgerlife import plans  # noqa: E402
from ledgerlife.plans import modelling  # noqa: E402
from ledgerlife.sources.sample_tables import SampleTables  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
#: The queries of this part of the library; the corpus operators have tests of their own.
OWN = plans.QUERIES
ORACLES = {name: sql for name, sql in ORACLES.items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan, node
    assert check_oracles.compare(df, con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(OWN) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan, node
    assert not df.isEmpty()


def test_training_rows_have_their_counters(spark):
    """Wherever a party has orders on the day, its row in the mart has order counters."""
    tables = SampleTables(spark, FOLDER)
    mart, _ = modelling._marts(tables, ("1995-01-01", "1995-12-31"), ("1996-01-01", "2001-08-01"))
    days = tables.order_detail.select(F.col("straccountid").alias("party_code"), F.col("dt").alias("sauda_date")).distinct()
    traded = mart.join(days, ["party_code", "sauda_date"], "left_semi")
    assert not traded.isEmpty() and traded.filter("Buy is null").isEmpty()


def test_entry_runs(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["cohort_start", "cohort_end", "parties", "as_of", "dormant", "dormancy_pct"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["dormancy_matrix", "dtu_profile", "trade_day_count_mix", "next_trade_dataset"])
def test_scans_do_not_grow_with_dates(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    log = "orders.parquet" if name == "dormancy_matrix" else "events.parquet"
    calendars = 1 if name == "next_trade_dataset" else 0  # the sample calendar is derived from the log's date range
    assert sum(1 for line in plan.splitlines() if "Scan parquet" in line and log in line) == 1 + calendars
