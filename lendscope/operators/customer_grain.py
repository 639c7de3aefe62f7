"""One row per customer: the relation that most customer views start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import measures as m
from lendscope.operators.states import CustomerStates
from lendscope.sources.book import BucketedBook

#: What customer views start from.
Source = DataFrame | CustomerStates | BucketedBook


def _measures() -> dict[str, Column]:
    return {
        "total_loans": m.loans(),
        "counted_loans": F.count("loan_id"),
        "total_borrowed": m.amount(),
        "avg_loan_size": m.mean_money("loan_amount"),
        "min_loan_size": F.min("loan_amount"),
        "max_loan_size": F.max("loan_amount"),
        "avg_interest_rate": m.mean("interest_rate"),
        "total_revenue": m.income(),
        "total_loss": m.loss(),
        "net_profit": m.net_profit(),
        "avg_risk_score": m.mean("risk_score"),
        "min_risk_score": F.min("risk_score"),
        "max_risk_score": F.max("risk_score"),
        "avg_days_past_due": m.mean("days_past_due"),
        "max_days_past_due": F.max("days_past_due"),
        "loans_with_arrears": F.count_if(m.overdue(0)),
        "loans_par_30": F.count_if(m.overdue()),
        "first_loan_date": F.min("origination_date"),
        "last_loan_date": F.max("origination_date"),
        "products": m.distinct_values("product_type"),
        "channels": m.distinct_values("channel"),
        "tiers": m.distinct_values("risk_tier"),
        "statuses": m.distinct_values("status"),
        "first_channel": first_of("channel")["channel"],
        "first_risk": first_of("risk_tier", "risk_score"),
        "latest_risk": latest_of("risk_tier", "risk_score"),
    }


def first_of(*names: str) -> Column:
    """Aggregate: the named columns of the earliest loan, ties broken by `loan_id`.

    The ordering keys lead the struct, so its minimum is the earliest loan and no
    customer's loans are sorted or gathered.
    """
    return F.min(F.struct("origination_date", "loan_id", *names))


def latest_of(*names: str) -> Column:
    """Aggregate: the named columns of the latest loan, ties broken by `loan_id`."""
    return F.max(F.struct("origination_date", "loan_id", *names))


def loan_rows(source: DataFrame | BucketedBook) -> DataFrame:
    return source.loans() if isinstance(source, BucketedBook) else source


def customer_metrics(loans: Source, *names: str, **more: Column) -> DataFrame:
    """`customer_id`, the named measures and `more` aggregates, one row per customer.

    Measures may also come from stored states; `more`, which are aggregates over loans, may not.
    Of a bucketed book, ordinary customers are aggregated where they lie.

    Every measure merges partial results of fixed or low-cardinality size, so a customer
    that holds a large part of all loans is reduced on the map side. A NULL customer is
    a group of its own.
    """
    if isinstance(loans, CustomerStates):
        if more:
            raise ValueError(f"states have no {', '.join(more)}")
        return loans.metrics(*names)
    if isinstance(loans, BucketedBook):
        return loans.by_customer(lambda part: customer_metrics(part, *names, **more))
    available = _measures()
    return loans.groupBy("customer_id").agg(
        *(available[name].alias(name) for name in names),
        *(aggregate.alias(name) for name, aggregate in more.items()),
    )
