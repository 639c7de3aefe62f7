"""Every query by name, as a function of the loan table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.operators import customer as c
from lendscope.operators import portfolio as p
from lendscope.operators import primitives as o
from lendscope.operators.states import CustomerStates, customer_states

AS_OF = date(2026, 4, 23)

LoanQuery = Callable[[DataFrame], DataFrame]

HEADLINE: dict[str, LoanQuery] = {
    "portfolio_overview": p.portfolio_overview,
    "par_bucket_distribution": p.par_bucket_distribution,
    "risk_tier_profitability": p.risk_tier_profitability,
    "product_performance": p.product_performance,
    "monthly_origination_trend": p.monthly_origination_trend,
    "channel_performance": p.channel_performance,
    "loan_status_breakdown": p.loan_status_breakdown,
    "high_risk_loans": p.high_risk_loans,
    "portfolio_concentration": p.portfolio_concentration,
    "risk_score_validation": p.risk_score_validation,
    "customer_segmentation": partial(c.customer_segmentation, as_of=AS_OF),
    "customer_clv": c.customer_clv,
    "customer_retention": c.customer_retention,
    "risk_migration": c.risk_migration,
    "product_affinity": c.product_affinity,
    "channel_acquisition": partial(c.channel_acquisition, as_of=AS_OF),
    "early_warning": partial(c.early_warning, as_of=AS_OF),
    "profitability_matrix": c.profitability_matrix,
    "acquisition_cohorts": partial(c.acquisition_cohorts, as_of=AS_OF),
    "top_customers": partial(c.top_customers, as_of=AS_OF),
}

# The top-k lists without their cut, so that every row is checked.
UNCUT: dict[str, LoanQuery] = {
    f"{name}_all": partial(HEADLINE[name], n=None)
    for name in (
        "high_risk_loans",
        "portfolio_concentration",
        "customer_clv",
        "early_warning",
        "top_customers",
    )
}

PRIMITIVES: dict[str, LoanQuery] = {
    "op_scan": o.scan,
    "op_project": o.project,
    "op_ratio": o.ratios,
    "op_round": o.rounded,
    "op_concat": o.concatenated,
    "op_month": o.month,
    "op_date_diff": o.date_difference,
    "op_age_days": partial(o.age_in_days, as_of=AS_OF),
    "op_nullif": o.guarded_division,
    "op_filter_or": o.filter_any_of_three,
    "op_in_list": o.filter_in_list,
    "op_filter_window": o.filter_on_window,
    "op_filter_flags": o.filter_on_flags,
    "op_having": o.having,
    "op_case_band": o.case_band,
    "op_case_no_else": o.case_without_else,
    "op_flags": o.flags,
    "op_risk_indicators": o.risk_indicators,
    "op_health_score": o.health_scores,
    "op_null_guard": o.null_guard,
    "op_equi_join": o.equi_join,
    "op_cross_join": o.single_rows_side_by_side,
    "op_scalar_subquery": o.scalar_subquery,
    "op_global_agg": o.global_aggregate,
    "op_group_agg": o.group_by_one,
    "op_group_multi": o.group_by_several,
    "op_group_alias": o.group_by_expression,
    "op_count_col": o.count_column,
    "op_count_distinct": o.count_distinct,
    "op_count_if": o.count_if,
    "op_conditional_sum": o.conditional_sum,
    "op_min_max": o.min_max,
    "op_max_string": o.max_string,
    "op_string_agg": o.string_agg,
    "op_two_level_agg": o.two_level,
    "op_mean_of_means": o.mean_of_means,
    "op_avg_nulls": o.mean_skipping_nulls,
    "op_median": o.medians,
    "op_row_number": o.row_number,
    "op_lag": o.look_back,
    "op_lag_over_agg": o.lag_over_aggregate,
    "op_first_value": o.first_value,
    "op_last_value": o.last_value,
    "op_first_channel": o.first_channel,
    "op_share_of_total": o.share_of_total,
    "op_share_of_amount": o.share_of_amount,
    "op_sort": o.sort,
    "op_ordinal_sort": o.ordinal_sort,
    "op_topk_multi": o.top_loans,
    "op_topk": o.top_borrowers,
    "op_distinct": o.distinct_rows,
}


def wide_book(loans: DataFrame) -> DataFrame:
    """The same loans with 500 products."""
    return loans.withColumn("product_type", F.concat(F.lit("product "), F.expr("loan_id % 500")))


def in_batches(loans: DataFrame) -> CustomerStates:
    """Customer states of the loans, merged from three batches."""
    first, *more = (customer_states(loans.where(F.col("loan_id") % 3 == batch)) for batch in range(3))
    return first.merged(*more)


# Views that can be read from states.
FROM_STATES = (
    "customer_segmentation",
    "product_affinity",
    "channel_acquisition",
    "early_warning",
    "profitability_matrix",
    "acquisition_cohorts",
)


def of_states(name: str) -> LoanQuery:
    return lambda loans: HEADLINE[name](in_batches(loans))


# Branches of a plan that test data of usual shape does not reach.
BRANCHES: dict[str, LoanQuery] = {
    "product_affinity_wide": lambda loans: c.product_affinity(wide_book(loans)),
    "customer_retention_sliced": partial(c.customer_retention, hot_rows=3),
    "op_row_number_sliced": partial(o.row_number, hot_rows=3),
    **{f"{name}_merged": of_states(name) for name in FROM_STATES},
}

CATALOG: dict[str, LoanQuery] = {**HEADLINE, **UNCUT, **PRIMITIVES, **BRANCHES}
