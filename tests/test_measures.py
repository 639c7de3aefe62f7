"""Sums of money over the whole schema, and beyond two decimals."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope import LOANS_SCHEMA
from lendscope.functions import measures as m
from lendscope.functions.numbers import band, band_names
from lendscope.operators import customer, portfolio
from lendscope.sources.loans import conform

MONEY = ("loan_amount", "expected_loss", "actual_loss")


def book(spark, loans, money, rate):
    """Loans of one customer from (amount, rate), with the given types."""
    kinds = dict.fromkeys(MONEY, money) | {"interest_rate": rate}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in LOANS_SCHEMA])
    return spark.createDataFrame(
        [
            (i, 1, "SME", "Online", a, r, 12, 650, "Low", 0, "Current", "Active", date(2024, 1, 1), D(1), D(0))
            for i, (a, r) in enumerate(loans)
        ],
        schema,
    )


CASES = {
    "largest": ([(D("9999999999999999.99"), D("999.99")), (D("1000.00"), D("30.00"))], T.DecimalType(18, 2), T.DecimalType(5, 2)),
    "third decimal": ([(D("1000.555"), D("12.345"))] * 2, T.DecimalType(18, 3), T.DecimalType(6, 3)),
    "negative": ([(D("-9999999999999999.99"), D("999.99")), (D("0.01"), D("0.01"))], T.DecimalType(18, 2), T.DecimalType(5, 2)),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("how", ["conformed", "as it is"])
def test_sums_are_exact(spark, case, how):
    loans, money, rate = CASES[case]
    df = book(spark, loans, money, rate)
    df = conform(df) if how == "conformed" else df
    amount, income = df.agg(m.amount(), m.income()).first()
    assert amount == sum(a for a, _ in loans)
    assert income == sum(a * r / 100 for a, r in loans)
    overview = portfolio.portfolio_overview(df).first().asDict()
    assert overview and customer.customer_segmentation(df, date(2026, 1, 1)).count() == 1


def test_conform_does_not_round(spark):
    finer = book(spark, [(D("1.5"), D("1.5"))], T.DecimalType(30, 8), T.DecimalType(5, 2))
    with pytest.raises(ValueError, match="loan_amount has 8 decimals"):
        conform(finer)
    plain = book(spark, [(D("1.50"), D("2.50"))], T.DecimalType(18, 2), T.DecimalType(5, 2))
    as_double = plain.withColumn("loan_amount", F.col("loan_amount").cast("double"))
    assert conform(as_double).first()["loan_amount"] == D("1.50")
    with pytest.raises(Exception, match="loan_amount has values of more than 2 decimals"):
        conform(as_double.withColumn("loan_amount", F.lit(1000.555))).collect()


def test_one_edge(spark):
    assert band_names([600]) == ["< 600", "600+"]
    df = spark.createDataFrame([(599,), (600,), (None,)], "x int")
    assert [r[0] for r in df.select(band(F.col("x"), [600])).collect()] == ["< 600", "600+", "600+"]


@pytest.mark.parametrize(
    "ids",
    [
        [], [None], [0], [-1, 0, 63, 64, -64, -65, 127, -1, None], [2**63 - 1, -(2**63), 2**63 - 1, 2**40, 2**40 + 64],
        list(range(-300, 300)) * 2, [k * 10**12 for k in range(200)],
    ],
)
def test_distinct_ids(spark, ids):
    df = spark.createDataFrame([(k % 3, i) for k, i in enumerate(ids)] + [(9, None)], "g int, i long").repartition(4)
    want = df.agg(F.count_distinct("i").alias("i")).first()
    assert m.distinct_ids(df, "i").first() == want
    by_group = df.groupBy("g").agg(F.count_distinct("i").alias("i"))
    assert sorted(m.distinct_ids(df, "i", "g").collect()) == sorted(by_group.collect())
    assert m.distinct_ids(df.withColumn("i", F.col("i").cast("decimal(20,0)")), "i").first() == want
