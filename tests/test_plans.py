"""The physical plans that the views rely on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from lendscope import read_loans
from lendscope.plans.catalog import CATALOG
from lendscope.sources.loans import load_loans
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("loans") / "loans")
    load_loans(spark, SMALL).write.parquet(path)
    return read_loans(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overview_expands_nothing_but_the_ids(stored):
    text = plan(CATALOG["portfolio_overview"](stored))
    assert all("loan_amount" not in line for line in text.splitlines() if "Expand" in line)
    assert "Join" not in text


def test_high_risk_filter_reaches_the_scan(stored):
    text = plan(CATALOG["high_risk_loans"](stored))
    assert re.search(r"PushedFilters: \[Or\(Or\(", text)
    assert "TakeOrderedAndProject" in text


def test_scans_read_only_what_they_use(stored):
    text = plan(CATALOG["monthly_origination_trend"](stored))
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert columns == "loan_amount:decimal(18,2),risk_score:int,days_past_due:int,origination_date:date"


@pytest.mark.parametrize("name", ["customer_clv", "early_warning", "top_customers", "portfolio_concentration"])
def test_top_lists_broadcast_a_few_ids(stored, name):
    text = plan(CATALOG[name](stored))
    assert text.count("TakeOrderedAndProject") == 2
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text


def test_cohorts_read_loans_once(stored):
    text = plan(CATALOG["acquisition_cohorts"](stored))
    assert text.count("FileScan") == 1
    assert "Join" not in text


def test_matrix_keeps_customers_out_of_a_single_task(stored):
    text = plan(CATALOG["profitability_matrix"](stored))
    assert not re.search(r"(?<!approx_)percentile\(", text)
    # One pass for the brackets, one for everything else.
    assert text.count("FileScan") == 2
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["product_affinity", "channel_acquisition", "op_string_agg"])
def test_sets_of_known_names_are_hashed(stored, name):
    text = plan(CATALOG[name](stored))
    assert "HashAggregate" in text
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text
    assert text.count("FileScan") == 1


@pytest.mark.parametrize("name", ["customer_segmentation", "portfolio_overview", "op_conditional_sum"])
def test_money_is_summed_in_longs_where_its_type_allows(stored, name):
    buffers = re.findall(r"partial_sum\(([^)]*)", plan(CATALOG[name](stored)))
    assert buffers
    finer = stored.withColumn("loan_amount", F.col("loan_amount").cast("decimal(20,4)"))
    # Decimals are summed in plans over finer types, and in no others.
    assert "partial_sum(loan_amount" not in plan(CATALOG[name](stored))
    assert re.search(r"partial_sum\((loan_amount|CASE WHEN \(days_past_due#\d+ > \d+\) THEN loan_amount)", plan(CATALOG[name](finer)))


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_python_and_no_cross_join(stored, name):
    text = plan(CATALOG[name](stored))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)
