"""Loan-portfolio views.

Each function takes the loan table and returns a lazy DataFrame. Results are one row,
one row per value of a short dimension, or a top-k list, and the aggregates combine on
the map side, so what is shuffled does not grow with the table. Rates over amounts that
sum to zero are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import measures as m
from lendscope.functions.numbers import band, band_names, pct, place_in, round_to
from lendscope.functions.rules import RuleTable, rule
from lendscope.operators.topk import ranked, restrict_to_top

# Fixed values, in the order reports list them.
PAR_BUCKETS = ("Current", "PAR 1-30", "PAR 31-60", "PAR 61-90", "PAR 90+")
RISK_TIERS = ("Low", "Medium", "High")
SCORE_EDGES = (600, 650, 700, 750)
PAR_LADDER = (0, 30, 60, 90)


def ladder_names(ladder: Sequence[int] = PAR_LADDER) -> dict[int, str]:
    """What columns call the loans of more days past due than each step of a ladder."""
    if len(ladder) < 2 or list(ladder) != sorted(set(ladder)):
        raise ValueError(f"a ladder rises in two steps at least: {ladder}")
    return {days: f"par_{days}" if days else "in_arrears" for days in ladder}


def portfolio_overview(loans: DataFrame, ladder: Sequence[int] = PAR_LADDER) -> DataFrame:
    """One row of key figures for the whole portfolio.

    `ladder` has the days past due that loans and amounts are counted beyond; the first step
    is what counts as arrears, and there are rates for the first, the second and the last.

    The sums need no shuffle beyond one row per task. The two distinct counts do, so
    they run as scalar subqueries over the bits of the ids alone: inside the same aggregate
    they would multiply every row by three and carry all its sums through the shuffle.
    """
    tier_names = {tier: tier.lower() for tier in reversed(RISK_TIERS)}
    arrears = ladder_names(ladder)
    names = list(arrears.values())
    sums = loans.agg(
        m.amount().alias("total_portfolio_value"),
        m.mean_money("loan_amount").alias("avg_loan_size"),
        round_to(m.mean("interest_rate"), 2).alias("avg_interest_rate_pct"),
        round_to(m.mean("risk_score"), 0).alias("avg_risk_score"),
        round_to(m.mean("tenure_months"), 1).alias("avg_tenure_months"),
        *(F.count_if(m.overdue(days)).alias(f"loans_{name}") for days, name in arrears.items()),
        F.count_if(F.col("status") == "Defaulted").alias("defaulted_loans"),
        *(m.amount_where(m.overdue(days)).alias(f"amount_{name}") for days, name in arrears.items()),
        m.amount_where(F.col("status") == "Defaulted").alias("defaulted_amount"),
        m.expected_loss().alias("total_expected_loss"),
        m.loss().alias("total_actual_loss"),
        *(
            F.count_if(F.col("risk_tier") == tier).alias(f"{name}_risk_loans")
            for tier, name in tier_names.items()
        ),
        m.income().alias("estimated_annual_interest_income"),
        m.amount_where(F.col("status") == "Active").alias("active_portfolio_value"),
        m.amount_where(m.non_performing()).alias("non_performing_value"),
        F.count_if(F.col("status") == "Active").alias("active_loans"),
        F.count_if(F.col("status") == "Closed").alias("closed_loans"),
        F.count_if(m.non_performing()).alias("non_performing_loans"),
    ).withColumns(
        {
            "total_loans": m.distinct_ids(loans, "loan_id").scalar(),
            "total_customers": m.distinct_ids(loans, "customer_id").scalar(),
        }
    )

    def money(name: str) -> Column:
        return F.col(name).cast("double").alias(name)

    def of_loans(name: str, alias: str) -> Column:
        return pct(F.col(name), F.col("total_loans")).alias(alias)

    def of_value(value: Column, alias: str) -> Column:
        return pct(value, F.col("total_portfolio_value")).alias(alias)

    return sums.select(
        "total_loans",
        "total_customers",
        money("total_portfolio_value"),
        "avg_loan_size",
        "avg_interest_rate_pct",
        "avg_risk_score",
        "avg_tenure_months",
        *(f"loans_{name}" for name in arrears.values()),
        "defaulted_loans",
        *(money(f"amount_{name}") for name in arrears.values()),
        money("defaulted_amount"),
        of_loans(f"loans_{names[0]}", "arrears_rate_pct"),
        of_value(F.col(f"amount_{names[0]}"), "par_rate_pct"),
        *(of_value(F.col(f"amount_{name}"), f"{name}_rate_pct") for name in dict.fromkeys((names[1], names[-1]))),
        of_loans("defaulted_loans", "default_rate_pct"),
        of_value(F.col("defaulted_amount"), "default_amount_pct"),
        money("total_expected_loss"),
        money("total_actual_loss"),
        of_value(F.col("total_expected_loss"), "expected_loss_rate_pct"),
        of_value(F.col("total_actual_loss"), "actual_loss_rate_pct"),
        *(f"{name}_risk_loans" for name in tier_names.values()),
        *(of_loans(f"{name}_risk_loans", f"{name}_risk_pct") for name in tier_names.values()),
        money("estimated_annual_interest_income"),
        money("active_portfolio_value"),
        money("non_performing_value"),
        "active_loans",
        "closed_loans",
        "non_performing_loans",
        of_loans("active_loans", "active_loan_pct"),
        of_loans("non_performing_loans", "npl_ratio_pct"),
        of_value(F.col("non_performing_value"), "npl_amount_pct"),
        of_value(
            F.col("estimated_annual_interest_income") - F.col("total_actual_loss"),
            "net_return_on_portfolio_pct",
        ),
    )


def par_bucket_distribution(loans: DataFrame) -> DataFrame:
    """Size, rate and loss of each delinquency bucket, from current to worst."""
    return (
        loans.groupBy("par_bucket")
        .agg(
            m.loans().alias("loan_count"),
            m.amount().cast("double").alias("total_amount"),
            round_to(m.mean("interest_rate"), 2).alias("avg_interest_rate"),
            round_to(m.loss(), 2).alias("total_loss"),
        )
        .orderBy(place_in(F.col("par_bucket"), PAR_BUCKETS), "par_bucket")
    )


def profile(loans: DataFrame, dimension: str | Column, **measures: Column) -> DataFrame:
    """Loans, value and mean rate of each value of a dimension, and more measures."""
    by = F.col(dimension) if isinstance(dimension, str) else dimension
    return loans.groupBy(by).agg(
        m.loans().alias("loan_count"),
        m.amount().cast("double").alias("portfolio_value"),
        round_to(m.mean("interest_rate"), 2).alias("avg_interest_rate"),
        *(measure.alias(name) for name, measure in measures.items()),
    )


def risk_tier_profitability(loans: DataFrame) -> DataFrame:
    """Interest income, loss and net return of each risk tier, from low to high."""
    return profile(
        loans,
        "risk_tier",
        estimated_interest_income=round_to(m.income(), 2),
        total_actual_loss=round_to(m.loss(), 2),
        net_return_pct=m.net_return(),
    ).orderBy(place_in(F.col("risk_tier"), RISK_TIERS), "risk_tier")


def product_performance(loans: DataFrame) -> DataFrame:
    """Delinquency, loss and return of each product, largest first."""
    return profile(
        loans,
        "product_type",
        loans_par_30_plus=F.count_if(m.overdue()),
        par_30_rate_pct=m.par_rate(),
        loss_rate_pct=m.loss_rate(),
        net_return_pct=m.net_return(),
    ).orderBy(F.desc("portfolio_value"), "product_type")


def monthly_origination_trend(loans: DataFrame) -> DataFrame:
    """Loans, amount, mean score and PAR-30 rate by month of origination."""
    return (
        loans.groupBy(m.month_of(F.col("origination_date")).alias("origination_month"))
        .agg(
            m.loans().alias("loans_originated"),
            m.amount().cast("double").alias("amount_originated"),
            round_to(m.mean("risk_score"), 0).alias("avg_risk_score"),
            m.par_rate().alias("par_30_rate_pct"),
        )
        .orderBy("origination_month")
    )


def channel_performance(loans: DataFrame) -> DataFrame:
    """Size, risk mix, delinquency and return of each channel, largest first."""
    by_tier = {f"{tier.lower()}_risk_count": F.count_if(F.col("risk_tier") == tier) for tier in RISK_TIERS}
    return (
        profile(
            loans,
            "channel",
            avg_loan_size=round_to(m.mean_money("loan_amount"), 0),
            **by_tier,
            par_30_rate_pct=m.par_rate(),
            loss_rate_pct=m.loss_rate(),
            net_return_pct=m.net_return(),
        )
        .select(
            "channel",
            "loan_count",
            "portfolio_value",
            "avg_loan_size",
            "avg_interest_rate",
            *by_tier,
            "par_30_rate_pct",
            "loss_rate_pct",
            "net_return_pct",
        )
        .orderBy(F.desc("portfolio_value"), "channel")
    )


def loan_status_breakdown(loans: DataFrame) -> DataFrame:
    """Size and loss of each status with its share of loans and of amount."""
    by_status = loans.groupBy("status").agg(
        m.loans().alias("loan_count"),
        m.amount().alias("total_amount"),
        round_to(m.mean_money("loan_amount"), 0).alias("avg_loan_size"),
        round_to(m.mean("days_past_due"), 0).alias("avg_days_past_due"),
        round_to(m.loss(), 2).alias("total_actual_loss"),
    )
    return (
        by_status.withColumns(
            {
                "pct_of_total_loans": m.share_of_rows("loan_count"),
                "pct_of_total_amount": m.share_of_rows("total_amount"),
            }
        )
        .withColumn("total_amount", F.col("total_amount").cast("double"))
        .orderBy(F.desc("loan_count"), "status")
    )


# Any of these makes a loan high-risk.
HIGH_RISK = RuleTable(
    (
        rule("tier", ("risk_tier", "=", "High")),
        rule("overdue", ("days_past_due", ">", 60)),
        rule("loss", ("actual_loss", ">", 0)),
    )
)

# Classes of delinquency, worst first.
DELINQUENCY = RuleTable(
    (
        rule(1, ("days_past_due", ">", 90)),
        rule(2, ("days_past_due", ">", 60)),
        rule(3, ("days_past_due", ">", 30)),
    ),
    4,
)


def is_high_risk(rules: RuleTable = HIGH_RISK) -> Column:
    """High tier, more than 60 days past due, or with a loss booked."""
    return rules.any()


def delinquency_class(classes: RuleTable = DELINQUENCY) -> Column:
    """1 for more than 90 days past due, then 2 (60), 3 (30) and 4."""
    return classes.first()


def high_risk_loans(
    loans: DataFrame, n: int | None = 20, rules: RuleTable = HIGH_RISK, classes: RuleTable = DELINQUENCY
) -> DataFrame:
    """The high-risk loans, worst delinquency class first and then by amount.

    `n` rows at most; all of them when `n` is None.
    """
    order = [delinquency_class(classes), F.desc("loan_amount"), F.asc("loan_id")]
    return ranked(loans.where(is_high_risk(rules)), order, n).select(
        "loan_id",
        "customer_id",
        "product_type",
        "channel",
        F.col("loan_amount").cast("double"),
        F.col("interest_rate").cast("double"),
        "risk_score",
        "risk_tier",
        "days_past_due",
        "par_bucket",
        "status",
        "origination_date",
        F.col("expected_loss").cast("double"),
        F.col("actual_loss").cast("double"),
        pct(F.col("actual_loss"), F.col("loan_amount")).alias("loss_rate_pct"),
    )


def portfolio_concentration(loans: DataFrame, n: int | None = 20) -> DataFrame:
    """Customers with more than one loan by exposure, with their share of the portfolio.

    `highest_risk_tier` is the alphabetically last tier, so Medium outranks Low and Low
    outranks High; see `worst_risk_tier` for the tier by severity.
    """
    order = [F.desc("total_exposure"), F.asc("customer_id")]
    leaders = (
        loans.groupBy("customer_id")
        .agg(m.loans().alias("number_of_loans"), m.amount().alias("total_exposure"))
        .where("number_of_loans > 1")
    )
    by_customer = (
        restrict_to_top(loans, leaders, order, n)
        .groupBy("customer_id")
        .agg(
            m.loans().alias("number_of_loans"),
            m.amount().alias("total_exposure"),
            round_to(m.mean("interest_rate"), 2).alias("avg_interest_rate"),
            round_to(m.mean("risk_score"), 0).alias("avg_risk_score"),
            F.max("risk_tier").alias("highest_risk_tier"),
            F.count_if(m.overdue()).alias("loans_par_30_plus"),
            round_to(m.loss(), 2).alias("total_loss"),
        )
        .where("number_of_loans > 1")
    )
    total = loans.agg(m.amount()).scalar()
    return ranked(
        by_customer.withColumn("pct_of_portfolio", pct(F.col("total_exposure"), total)), order, n
    ).withColumn("total_exposure", F.col("total_exposure").cast("double"))


def worst_risk_tier() -> Column:
    """Aggregate: the most severe tier present, where `max` would go by the alphabet."""
    return F.max_by("risk_tier", F.array_position(F.array(*map(F.lit, RISK_TIERS)), F.col("risk_tier")))


def risk_score_validation(loans: DataFrame, edges: Sequence[int] = SCORE_EDGES) -> DataFrame:
    """Actual against expected loss in each risk-score band, in ascending order."""
    return profile(
        loans,
        band(F.col("risk_score"), edges).alias("risk_score_band"),
        par_30_rate_pct=m.par_rate(),
        actual_loss_rate_pct=m.loss_rate(),
        expected_loss_rate_pct=pct(m.expected_loss(), m.amount()),
        loss_variance_pct=m.loss_variance(),
    ).orderBy(place_in(F.col("risk_score_band"), band_names(edges)))
