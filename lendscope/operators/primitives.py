"""The single building blocks of the views, each as a query of its own.

They share the column builders of the views, so checking one here checks what the views
are made of.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import measures as m
from lendscope.functions.numbers import band, joined, pct, place_in, round_to
from lendscope.operators import categories as cat
from lendscope.operators import customer as c
from lendscope.operators import portfolio as p
from lendscope.operators.customer_grain import customer_metrics, first_of, latest_of
from lendscope.operators.median import exact_medians
from lendscope.operators.skew import HOT_ROWS, join_customers, loan_sequence, with_previous_count
from lendscope.operators.topk import ranked
from lendscope.sources.book import BucketedBook


def _double(*names: str) -> dict[str, Column]:
    return {name: F.col(name).cast("double") for name in names}


# Scan, projection, arithmetic


def scan(loans: DataFrame) -> DataFrame:
    return loans.withColumns(_double("loan_amount", "interest_rate", "expected_loss", "actual_loss"))


def project(loans: DataFrame) -> DataFrame:
    yearly = F.col("book.loan_amount") * F.col("book.interest_rate") / 100
    return loans.alias("book").select(
        "book.loan_id",
        F.col("book.customer_id").alias("borrower_id"),
        yearly.cast("double").alias("yearly_interest"),
    )


def ratios(loans: DataFrame) -> DataFrame:
    return loans.groupBy("tenure_months").agg(
        m.par_rate().alias("par_30_rate_pct"),
        m.loss_rate().alias("loss_rate_pct"),
        m.net_return().alias("net_return_pct"),
    )


def rounded(loans: DataFrame) -> DataFrame:
    interest = F.col("loan_amount") * F.col("interest_rate") / 100
    return loans.select(
        "loan_id", *(round_to(interest, digits).alias(f"interest_{digits}") for digits in (0, 1, 2))
    )


def concatenated(loans: DataFrame) -> DataFrame:
    return loans.select("loan_id", F.concat("product_type", F.lit(" / "), "channel").alias("line"))


def month(loans: DataFrame) -> DataFrame:
    return loans.select("loan_id", m.month_of(F.col("origination_date")).alias("origination_month"))


def date_difference(loans: DataFrame) -> DataFrame:
    return customer_metrics(loans, "first_loan_date", "last_loan_date").select(
        "customer_id",
        F.datediff("last_loan_date", "first_loan_date").cast("long").alias("relationship_days"),
    )


def age_in_days(loans: DataFrame, as_of: date | None = None) -> DataFrame:
    return customer_metrics(loans, "last_loan_date").select(
        "customer_id", m.days_since(F.col("last_loan_date"), as_of).alias("days_since_last_loan")
    )


def guarded_division(loans: DataFrame) -> DataFrame:
    booked = F.nullif(F.col("actual_loss"), F.lit(0))
    return loans.select(
        "loan_id",
        pct(F.col("actual_loss"), F.col("loan_amount")).alias("loss_rate_pct"),
        round_to(F.col("expected_loss").cast("double") / booked.cast("double"), 2).alias("expected_per_actual"),
    )


# Filters


def filter_any_of_three(loans: DataFrame) -> DataFrame:
    return loans.where(p.is_high_risk()).select(
        "loan_id", "risk_tier", "days_past_due", F.col("actual_loss").cast("double")
    )


def filter_in_list(loans: DataFrame) -> DataFrame:
    return loans.where(m.non_performing()).select("loan_id", "status")


def filter_on_window(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return row_number(loans, hot_rows).where("loan_number > 1")


def filter_on_flags(loans: DataFrame) -> DataFrame:
    return (
        _flagged(loans)
        .select("customer_id", c.flag_total().alias("total_risk_flags"))
        .where("total_risk_flags > 0")
    )


def having(loans: DataFrame) -> DataFrame:
    return loans.groupBy("customer_id").agg(m.loans().alias("number_of_loans")).where("number_of_loans > 1")


# Conditional expressions


def case_band(loans: DataFrame) -> DataFrame:
    return loans.select("loan_id", band(F.col("risk_score"), p.SCORE_EDGES).alias("risk_score_band"))


def case_without_else(loans: DataFrame) -> DataFrame:
    """Quadrant actions per loan. No action is defined for medium risk, which gives NULL."""
    value = F.when(F.col("loan_amount") >= 250_000, "High Value").otherwise("Low Value")
    risk = F.concat("risk_tier", F.lit(" Risk"))
    return loans.select("loan_id", c.strategic_action(value, risk).alias("strategic_action"))


def _flagged(loans: DataFrame) -> DataFrame:
    return customer_metrics(loans, *c.WARNING_MEASURES).withColumns(c.warning_flags())


def flags(loans: DataFrame) -> DataFrame:
    return _flagged(loans).select("customer_id", *c.WARNING_TEXTS)


def risk_indicators(loans: DataFrame) -> DataFrame:
    return _flagged(loans).select("customer_id", c.flag_texts().alias("risk_indicators"))


def health_scores(loans: DataFrame) -> DataFrame:
    return customer_metrics(loans, *c.HEALTH_MEASURES).select(
        "customer_id", c.health_score().alias("customer_health_score")
    )


def null_guard(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    before = F.col("previous_loan_amount")
    growth = pct(F.col("loan_amount") - before, before)
    needed = loans.select("customer_id", "loan_id", "origination_date", "loan_amount", "days_past_due")
    return loan_sequence(needed, hot_rows).select(
        "customer_id", "loan_id", F.when(before.isNotNull(), growth).alias("loan_size_growth_pct")
    )


# Joins and subqueries


def equi_join(loans: DataFrame | BucketedBook, hot_rows: int = HOT_ROWS) -> DataFrame:
    if isinstance(loans, BucketedBook):
        joined_loans = loans.join_customers(lambda part: customer_metrics(part, "first_loan_date"))
    else:
        needed = loans.select("loan_id", "customer_id", "origination_date")
        joined_loans = join_customers(needed, customer_metrics(loans, "first_loan_date"), hot_rows)
    return joined_loans.select(
        "loan_id",
        "customer_id",
        "first_loan_date",
        F.datediff("origination_date", "first_loan_date").cast("long").alias("days_since_first_loan"),
    )


def single_rows_side_by_side(loans: DataFrame) -> DataFrame:
    """Two one-row relations in one row. A scalar subquery enforces the single row."""
    risk = loans.agg(F.count_if(m.overdue()).alias("loans_par_30"))
    return loans.agg(m.loans().alias("total_loans")).withColumns(
        {
            "loans_par_30": risk.scalar(),
            "par_30_share_pct": pct(risk.scalar(), F.col("total_loans")),
        }
    )


def scalar_subquery(loans: DataFrame) -> DataFrame:
    total = loans.agg(m.amount()).scalar()
    return customer_metrics(loans, "total_borrowed").select(
        "customer_id", pct(F.col("total_borrowed"), total).alias("pct_of_portfolio")
    )


# Aggregations


def global_aggregate(loans: DataFrame) -> DataFrame:
    return loans.agg(
        m.loans().alias("loan_count"),
        m.amount().cast("double").alias("portfolio_value"),
        m.mean_money("loan_amount").alias("avg_loan_size"),
    )


def group_by_one(loans: DataFrame) -> DataFrame:
    return loans.groupBy("product_type").agg(
        m.loans().alias("loan_count"),
        m.amount().cast("double").alias("portfolio_value"),
        round_to(m.mean("interest_rate"), 2).alias("avg_interest_rate"),
    )


def group_by_several(loans: DataFrame) -> DataFrame:
    return loans.groupBy("product_type", "channel", "risk_tier").agg(
        m.loans().alias("loan_count"), round_to(m.loss(), 2).alias("total_loss")
    )


def group_by_expression(loans: DataFrame) -> DataFrame:
    return loans.groupBy(m.month_of(F.col("origination_date")).alias("origination_month")).agg(
        m.loans().alias("loans_originated")
    )


def count_column(loans: DataFrame) -> DataFrame:
    return loans.groupBy("channel").agg(
        F.count("loan_id").alias("loan_count"),
        F.count(F.nullif(F.col("actual_loss"), F.lit(0))).alias("loans_with_loss"),
    )


def count_distinct(loans: DataFrame) -> DataFrame:
    counted = m.distinct_ids(loans, "customer_id", "product_type")
    return counted.withColumnRenamed("customer_id", "customers")


def count_if(loans: DataFrame) -> DataFrame:
    return loans.groupBy("channel").agg(
        *(F.count_if(m.overdue(days)).alias(f"loans_par_{days}") for days in p.PAR_LADDER)
    )


def conditional_sum(loans: DataFrame) -> DataFrame:
    return loans.groupBy("channel").agg(
        *(m.amount_where(m.overdue(days)).cast("double").alias(f"amount_par_{days}") for days in p.PAR_LADDER)
    )


def min_max(loans: DataFrame) -> DataFrame:
    return loans.groupBy("product_type").agg(
        F.min("origination_date").alias("first_loan_date"),
        F.max("origination_date").alias("last_loan_date"),
        F.min("loan_amount").cast("double").alias("min_loan_size"),
        F.max("loan_amount").cast("double").alias("max_loan_size"),
    )


def max_string(loans: DataFrame) -> DataFrame:
    return loans.groupBy("customer_id").agg(
        F.max("risk_tier").alias("highest_risk_tier"), p.worst_risk_tier().alias("worst_risk_tier")
    )


def string_agg(loans: DataFrame, most_names: int = cat.MOST_NAMES) -> DataFrame:
    found = {name: cat.coded(loans, name, most_names) for name in ("product_type", "status")}
    sets = {}
    for name, names in found.items():
        sets |= {name: m.distinct_values(name)} if names is None else names.masks()

    def listed(name: str) -> Column:
        return joined(F.col(name) if found[name] is None else found[name].held())

    return customer_metrics(loans, **sets).select(
        "customer_id", listed("product_type").alias("product_mix"), listed("status").alias("loan_statuses")
    )


def two_level(loans: DataFrame) -> DataFrame:
    return (
        customer_metrics(loans, "total_loans", "total_borrowed")
        .groupBy("total_loans")
        .agg(
            m.loans().alias("customer_count"),
            F.sum("total_borrowed").cast("double").alias("total_portfolio_value"),
        )
    )


def mean_of_means(loans: DataFrame) -> DataFrame:
    return (
        customer_metrics(loans, "total_loans", "avg_days_past_due", "avg_risk_score")
        .groupBy("total_loans")
        .agg(
            round_to(F.avg("avg_days_past_due"), 1).alias("avg_days_past_due"),
            round_to(F.avg("avg_risk_score"), 0).alias("avg_risk_score"),
        )
    )


def mean_skipping_nulls(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return (
        look_back(loans, hot_rows)
        .groupBy("loan_number")
        .agg(
            m.loans().alias("loan_count"),
            round_to(F.avg("days_between_loans"), 0).alias("avg_days_between_loans"),
        )
    )


def medians(loans: DataFrame) -> DataFrame:
    customers = customer_metrics(loans, "net_profit", "avg_risk_score")
    return exact_medians(customers, "net_profit", "avg_risk_score").select(
        round_to(F.col("net_profit"), 6).alias("median_net_profit"),
        round_to(F.col("avg_risk_score"), 6).alias("median_risk_score"),
    )


# Windows


def _sequenced(loans: DataFrame, hot_rows: int) -> DataFrame:
    needed = loans.select("customer_id", "loan_id", "origination_date", "loan_amount", "days_past_due")
    return loan_sequence(needed, hot_rows)


def row_number(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _sequenced(loans, hot_rows).select("customer_id", "loan_id", "loan_number")


def look_back(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _sequenced(loans, hot_rows).select(
        "customer_id",
        "loan_id",
        "loan_number",
        "previous_loan_date",
        F.col("previous_loan_amount").cast("double"),
        "previous_loan_dpd",
        F.datediff("origination_date", "previous_loan_date").cast("long").alias("days_between_loans"),
    )


def lag_over_aggregate(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    per_ordinal = row_number(loans, hot_rows).groupBy("loan_number").agg(
        F.count("customer_id").alias("customer_count")
    )
    return with_previous_count(per_ordinal, "loan_number", "customer_count", "previous_count")


def first_value(loans: DataFrame) -> DataFrame:
    return _endpoint(loans, first_of("risk_tier", "risk_score"), "first")


def last_value(loans: DataFrame) -> DataFrame:
    return _endpoint(loans, latest_of("risk_tier", "risk_score"), "latest")


def _endpoint(loans: DataFrame, loan: Column, prefix: str) -> DataFrame:
    return (
        loans.groupBy("customer_id")
        .agg(loan.alias("loan"))
        .select(
            "customer_id",
            F.col("loan.risk_tier").alias(f"{prefix}_risk_tier"),
            F.col("loan.risk_score").alias(f"{prefix}_risk_score"),
        )
    )


def first_channel(loans: DataFrame) -> DataFrame:
    return customer_metrics(loans, "first_channel").withColumnRenamed("first_channel", "acquisition_channel")


def share_of_total(loans: DataFrame) -> DataFrame:
    by_status = loans.groupBy("status").agg(m.loans().alias("loan_count"))
    return by_status.withColumn("pct_of_loans", m.share_of_rows("loan_count"))


def share_of_amount(loans: DataFrame) -> DataFrame:
    by_status = loans.groupBy("status").agg(m.amount().alias("amount"))
    return by_status.withColumn("pct_of_amount", m.share_of_rows("amount")).withColumns(_double("amount"))


# Sorts, limits, sets


def sort(loans: DataFrame) -> DataFrame:
    return group_by_one(loans).orderBy(F.desc("portfolio_value"), "product_type")


def ordinal_sort(loans: DataFrame) -> DataFrame:
    counts = loans.groupBy("par_bucket").agg(m.loans().alias("loan_count"))
    return counts.orderBy(place_in(F.col("par_bucket"), p.PAR_BUCKETS), "par_bucket")


def top_loans(loans: DataFrame, n: int = 20) -> DataFrame:
    listed = loans.select("loan_id", "days_past_due", "loan_amount")
    order = [p.delinquency_class(), F.desc("loan_amount"), F.asc("loan_id")]
    return ranked(listed, order, n).withColumns(_double("loan_amount"))


def top_borrowers(loans: DataFrame, n: int = 20) -> DataFrame:
    order = [F.desc("total_borrowed"), F.asc("customer_id")]
    return ranked(customer_metrics(loans, "total_borrowed"), order, n).withColumns(_double("total_borrowed"))


def distinct_rows(loans: DataFrame) -> DataFrame:
    return loans.select("customer_id", "product_type").distinct()
