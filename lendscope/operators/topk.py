"""Top-k lists that do not aggregate everything in order to show a few customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.operators.customer_grain import Source, loan_rows
from lendscope.operators.states import CustomerStates


def ranked(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """`df` in the given order, cut after `n` rows unless `n` is None."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def restrict_to_top(
    loans: Source, leaders: DataFrame, order: Sequence[Column], n: int | None
) -> DataFrame | CustomerStates:
    """The loans, or the states, of the customers that rank among the first `n` of `leaders`.

    `leaders` holds one narrow row per customer: the ranking keys only. The wide profile
    is then computed for `n` customers instead of all, at the price of a second scan that
    a broadcast of at most `n` ids filters without a shuffle. `n=None` keeps all loans.
    """
    if n is None:
        return loans
    top = ranked(leaders, order, n).select(F.col("customer_id").alias("top_id"))
    if isinstance(loans, CustomerStates):
        return loans.of_customers(top, "top_id")
    return loan_rows(loans).join(
        F.broadcast(top), F.col("customer_id").eqNullSafe(F.col("top_id")), "left_semi"
    )
