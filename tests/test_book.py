"""A book bucketed by customer: the same results, without customer shuffles."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendscope.operators import customer as c
from lendscope.operators import primitives as o
from lendscope.operators.customer_grain import customer_metrics
from lendscope.sources.book import read_book, write_book
from lendscope.sources.loans import load_loans
from tests.conftest import SMALL

TODAY = date(2026, 4, 23)


@pytest.fixture(scope="module")
def loans(spark):
    owner = F.when(F.col("loan_id") % 3 == 0, F.lit(7)).when(F.col("loan_id") % 50 > 0, F.col("customer_id"))
    return load_loans(spark, SMALL).withColumn("customer_id", owner)


@pytest.fixture(scope="module")
def book(spark, loans, tmp_path_factory):
    write_book(loans, "book", 5, hot_rows=100, path=str(tmp_path_factory.mktemp("book")))
    yield read_book(spark, "book")
    spark.sql("drop table book")
    spark.sql("drop table book_hot")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_every_loan_is_in_one_table(loans, book):
    assert rows(book.loans()) == rows(loans)
    assert {r[0] for r in book.hot.select("customer_id").distinct().collect()} == {7}
    assert book.ordinary.where("customer_id is null").count() > 0


def test_ordinary_customers_are_not_shuffled(book):
    text = plan(customer_metrics(book.ordinary, "total_borrowed", "net_profit"))
    assert "Exchange" not in text and text.count("FileScan") == 1
    both = plan(customer_metrics(book, "total_borrowed"))
    assert both.count("Exchange hashpartitioning(customer_id") == 1  # that of the few hot ones


def test_join_is_side_by_side(spark, loans, book):
    joined = o.equi_join(book)
    text = plan(joined.where("customer_id <> -1"))
    ordinary = plan(book.ordinary.join(customer_metrics(book.ordinary, "first_loan_date").hint("merge"), "customer_id"))
    assert "SortMergeJoin" in ordinary and "Exchange" not in ordinary
    assert "SortMergeJoin" in text and "BroadcastHashJoin" in text
    assert rows(joined) == rows(o.equi_join(loans))


@pytest.mark.parametrize(
    "view",
    [
        lambda x: c.customer_segmentation(x, TODAY), c.customer_clv, c.product_affinity, lambda x: c.channel_acquisition(x, TODAY),
        lambda x: c.early_warning(x, TODAY), c.profitability_matrix, lambda x: c.acquisition_cohorts(x, TODAY), c.risk_migration,
    ],
)
def test_views_of_a_book(loans, book, view):
    assert view(book).collect() == view(loans).collect()
