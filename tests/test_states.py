"""Customer states: merging batches, and views that read states."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendscope.operators import customer as c
from lendscope.operators.customer_grain import customer_metrics
from lendscope.operators.states import customer_states, read_states
from lendscope.sources.loans import load_loans
from tests.conftest import SMALL

TODAY = date(2026, 4, 23)

NAMES = (
    "total_loans", "counted_loans", "total_borrowed", "avg_loan_size", "min_loan_size", "max_loan_size", "avg_interest_rate",
    "total_revenue", "total_loss", "net_profit", "avg_risk_score", "min_risk_score", "max_risk_score", "avg_days_past_due",
    "max_days_past_due", "loans_with_arrears", "loans_par_30", "first_loan_date", "last_loan_date", "products", "channels",
    "tiers", "statuses", "first_channel", "first_risk", "latest_risk",
)

VIEWS = {
    "segmentation": lambda x: c.customer_segmentation(x, TODAY),
    "affinity": c.product_affinity,
    "channels": lambda x: c.channel_acquisition(x, TODAY),
    "warning": lambda x: c.early_warning(x, TODAY),
    "warning, all": lambda x: c.early_warning(x, TODAY, n=None),
    "matrix": c.profitability_matrix,
    "cohorts": lambda x: c.acquisition_cohorts(x, TODAY),
    "value": c.customer_clv,
    "migration": c.risk_migration,
    "top": lambda x: c.top_customers(x, TODAY),
}


@pytest.fixture(scope="module")
def book(spark):
    """Loans with a hot customer, and NULLs in every column but the ids."""
    loans = load_loans(spark, SMALL)
    pick = F.col("loan_id") % 11
    nulls = {
        name: F.when(pick != k % 7, F.col(name))
        for k, name in enumerate(n for n in loans.columns if n not in ("loan_id", "customer_id"))
    }
    owner = F.when(pick < 3, F.lit(7)).when(pick > 3, F.col("customer_id"))
    return loans.withColumns(nulls).withColumn("customer_id", owner).cache()


@pytest.fixture(scope="module")
def merged(book, spark, tmp_path_factory):
    """Three batches of different size, the first ones stored."""
    folder = tmp_path_factory.mktemp("states")
    batch = F.when(F.col("loan_id") % 13 == 0, 0).when(F.col("loan_id") % 2 == 0, 1).otherwise(2)
    first, second, third = (customer_states(book.where(batch == k)) for k in range(3))
    first.write(f"{folder}/a")
    read_states(spark, f"{folder}/a").merged(second).write(f"{folder}/b")
    return read_states(spark, f"{folder}/b").merged(third)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_states_have_every_measure(book):
    assert rows(customer_states(book).metrics(*NAMES)) == rows(customer_metrics(book, *NAMES))


def test_merged_states_are_those_of_all_loans(book, merged):
    assert rows(merged.metrics(*NAMES)) == rows(customer_metrics(book, *NAMES))
    whole = customer_states(book)
    assert merged.table.schema.simpleString() == whole.table.schema.simpleString()
    assert rows(merged.table) == rows(whole.table)


@pytest.mark.parametrize("name", VIEWS)
def test_views_of_states(book, merged, name):
    expected = VIEWS[name](book)
    got = VIEWS[name](merged)
    assert got.columns == expected.columns
    assert got.collect() == expected.collect()


def test_empty_batches(book):
    nothing = customer_states(book.limit(0))
    assert nothing.merged().table.collect() == []
    some = customer_states(book.where("loan_id < 500"))
    assert rows(some.merged(nothing).table) == rows(nothing.merged(some).table) == rows(some.table)


def test_views_of_stored_states_aggregate_no_customers(book, spark, tmp_path):
    customer_states(book).write(str(tmp_path / "s"))
    view = c.customer_segmentation(read_states(spark, str(tmp_path / "s")), TODAY)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" not in plan
    assert plan.count("FileScan") == 1 and "products" not in plan


def test_other_tables_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no customer states"):
        read_states(spark, str(tmp_path / "x"))


def test_loan_aggregates_need_loans(merged):
    with pytest.raises(ValueError, match="states have no extra"):
        customer_metrics(merged, "total_loans", extra=F.max("loan_id"))
