"""Slicing hot customers changes where work is done, and nothing else."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendscope.operators import customer as c
from lendscope.operators import primitives as o
from lendscope.operators.customer_grain import customer_metrics
from lendscope.operators.skew import hot_customers, in_slices, join_customers, loan_sequence, split_hot
from lendscope.sources.loans import load_loans
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the loans on one customer, many on one day, and NULL ids and dates."""
    loans = load_loans(spark, SMALL)
    pick = F.col("loan_id") % 9
    return loans.withColumns(
        {
            "customer_id": F.when(pick < 3, F.lit(7)).when(pick == 3, F.lit(None)).otherwise(F.col("customer_id")),
            "origination_date": F.when(pick == 1, F.lit("1996-05-05").cast("date"))
            .when((pick == 2) & (F.col("loan_id") % 7 == 0), F.lit(None))
            .otherwise(F.col("origination_date")),
        }
    )


def plain_sequence(loans):
    order = Window.partitionBy("customer_id").orderBy("origination_date", "loan_id")
    return loans.withColumns(
        {
            "loan_number": F.row_number().over(order).cast("long"),
            "previous_loan_date": F.lag("origination_date").over(order),
            "previous_loan_amount": F.lag("loan_amount").over(order),
            "previous_loan_dpd": F.lag("days_past_due").over(order),
        }
    )


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("hot_rows", [1, 7, 100, 10_000])
def test_sequence_equals_one_window(skewed, hot_rows):
    got = loan_sequence(skewed, hot_rows)
    want = plain_sequence(skewed)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_some_customers_are_hot(skewed):
    hot = {r["hot_id"]: r["slices"] for r in hot_customers(skewed, 100).collect()}
    assert set(hot) == {7, None}
    assert hot[7] == -(-skewed.where("customer_id = 7").count() // 100)


@pytest.mark.parametrize("hot_rows", [1, 100])
def test_retention_does_not_depend_on_slicing(skewed, hot_rows):
    assert c.customer_retention(skewed, hot_rows).collect() == c.customer_retention(skewed).collect()


@pytest.mark.parametrize("hot_rows", [1, 100, 10_000])
def test_join_equals_plain_join(skewed, hot_rows):
    firsts = customer_metrics(skewed, "first_loan_date")
    got = join_customers(skewed.select("loan_id", "customer_id"), firsts, hot_rows)
    want = skewed.select("loan_id", "customer_id").join(firsts, "customer_id").select(*got.columns)
    assert rows(got) == rows(want)


def test_previous_count_equals_lag(skewed):
    got = o.lag_over_aggregate(skewed, 100).orderBy("loan_number").collect()
    counts = plain_sequence(skewed).groupBy("loan_number").agg(F.count("customer_id").alias("customer_count"))
    want = counts.withColumn(
        "previous_count", F.lag("customer_count").over(Window.orderBy("loan_number"))
    ).orderBy("loan_number")
    assert got == want.collect()


CROWDS = {
    "one day": ("cast('2000-01-01' as date)", "loan_id"),
    # Nine in ten ids lie in a hundredth of their span.
    "ids": ("cast('2000-01-01' as date)", "if(loan_id % 10 = 0, loan_id * 1000, loan_id)"),
    "days": ("date_add('2000-01-01', int(if(loan_id % 10 = 0, loan_id, 3)))", "loan_id"),
    "no ids": ("cast('2000-01-01' as date)", "if(loan_id % 10 = 0, loan_id, null)"),
}


@pytest.mark.parametrize("case", CROWDS)
def test_slices_are_of_about_equal_size(spark, case):
    """However dates and ids crowd, the largest slice is at most twice the mean."""
    hot_rows, n = 2_000, 60_000
    loans = spark.range(n).selectExpr(
        "id as loan_id", "7L as customer_id", "cast(id as decimal(18,2)) as loan_amount", "cast(id % 90 as int) as days_past_due"
    )
    day, number = CROWDS[case]
    crowd = loans.selectExpr(
        "customer_id", "loan_amount", "days_past_due", f"{day} as origination_date", f"{number} as loan_id"
    )
    _, hot = split_hot(crowd, hot_rows)
    sizes = [r["count"] for r in in_slices(hot, hot_rows).groupBy("slice").count().collect()]
    assert len(sizes) == 30 and sum(sizes) == n
    assert max(sizes) <= 2 * n / 30
    if case != "no ids":
        assert rows(loan_sequence(crowd, hot_rows)) == rows(plain_sequence(crowd))


def test_slices_follow_the_order(skewed):
    _, hot = split_hot(skewed, 20)
    ends = (
        in_slices(hot, 20)
        .groupBy("customer_id", "slice")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"))
        .withColumn("before", F.lag("high").over(Window.partitionBy("customer_id").orderBy("slice")))
    )
    assert ends.count() > 10
    assert ends.where("before >= low").count() == 0
