"""Customers as mergeable states, stored once and brought up to date by batches of loans.

A state has sums, counts, extremes and sets of one customer. States of two sets of loans merge
into the state of both, so a new batch costs one pass over the batch and one over the states,
not over all loans. Views that start from customers read states in place of loans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.functions import measures as m
from lendscope.functions.numbers import ratio

_MEANS = ("interest_rate", "risk_score", "days_past_due")
_SETS = {"products": "product_type", "channels": "channel", "tiers": "risk_tier", "statuses": "status"}


def _union(name: str) -> Column:
    """Aggregate: sorted union of sets, each of few names."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))))


def _parts() -> dict[str, tuple[Column, Callable[[str], Column]]]:
    """Each part of a state: how loans make it, and how states merge it."""
    parts = {
        "total_loans": (m.loans(), F.sum),
        "counted_loans": (F.count("loan_id"), F.sum),
        "counted_amounts": (F.count("loan_amount"), F.sum),
        "total_borrowed": (m.amount(), F.sum),
        "total_revenue": (m.income(), F.sum),
        "total_loss": (m.loss(), F.sum),
        "min_loan_size": (F.min("loan_amount"), F.min),
        "max_loan_size": (F.max("loan_amount"), F.max),
        "min_risk_score": (F.min("risk_score"), F.min),
        "max_risk_score": (F.max("risk_score"), F.max),
        "max_days_past_due": (F.max("days_past_due"), F.max),
        "loans_with_arrears": (F.count_if(m.overdue(0)), F.sum),
        "loans_par_30": (F.count_if(m.overdue()), F.sum),
        "first_loan_date": (F.min("origination_date"), F.min),
        "last_loan_date": (F.max("origination_date"), F.max),
        "first_loan": (F.min(F.struct("origination_date", "loan_id", "channel")), F.min),
        "first_risk": (F.min(F.struct("origination_date", "loan_id", "risk_tier", "risk_score")), F.min),
        "latest_risk": (F.max(F.struct("origination_date", "loan_id", "risk_tier", "risk_score")), F.max),
    }
    for name in _MEANS:
        parts[f"{name}_sum"] = (F.sum(name), F.sum)
        parts[f"{name}_count"] = (F.count(name), F.sum)
    for name, column in _SETS.items():
        parts[name] = (m.distinct_values(column), _union)
    return parts


def _closed(df: DataFrame) -> DataFrame:
    """Sums in their widest type, so that merged states have the types of their parts."""
    widest = {
        field.name: F.col(field.name).cast(T.DecimalType(38, field.dataType.scale))
        for field in df.schema
        if isinstance(field.dataType, T.DecimalType)
    }
    return df.withColumns(widest)


@dataclass(frozen=True)
class CustomerStates:
    """A table with one state for each customer (NULL is a customer like any other)."""

    table: DataFrame

    def merged(self, *others: CustomerStates) -> CustomerStates:
        """The states of all loans of all tables. Each loan is to be in one of them."""
        rows = self.table
        for other in others:
            rows = rows.unionByName(other.table)
        merge = [how(name).alias(name) for name, (_, how) in _parts().items()]
        return CustomerStates(_closed(rows.groupBy("customer_id").agg(*merge)))

    def metrics(self, *names: str) -> DataFrame:
        """`customer_id` and the named measures, as `customer_metrics` has them."""
        derived = {
            "avg_loan_size": ratio(F.col("total_borrowed"), F.col("counted_amounts")),
            "net_profit": F.col("total_revenue") - F.col("total_loss"),
            "first_channel": F.col("first_loan.channel"),
            **{f"avg_{name}": ratio(F.col(f"{name}_sum"), F.col(f"{name}_count")) for name in _MEANS},
        }
        own = (derived.get(name, F.col(name)).alias(name) for name in names)
        return self.table.select("customer_id", *own)

    def of_customers(self, ids: DataFrame, name: str) -> CustomerStates:
        """The states of a few customers, whose ids are a column of a small table."""
        same = F.col("customer_id").eqNullSafe(F.col(name))
        return CustomerStates(self.table.join(F.broadcast(ids.select(name)), same, "left_semi"))

    def write(self, path: str) -> None:
        """Store the states as Parquet, in a folder that does not exist yet: a table that is
        merged with a batch is read while the result is written."""
        self.table.write.parquet(path)


def customer_states(loans: DataFrame) -> CustomerStates:
    make = [made.alias(name) for name, (made, _) in _parts().items()]
    return CustomerStates(_closed(loans.groupBy("customer_id").agg(*make)))


def read_states(spark: SparkSession, path: str) -> CustomerStates:
    table = spark.read.parquet(path)
    missing = {"customer_id", *_parts()} - set(table.columns)
    if missing:
        raise ValueError(f"no customer states: {path} lacks {', '.join(sorted(missing))}")
    return CustomerStates(table)
