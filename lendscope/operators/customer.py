"""Customer views: segments, value, retention, migration, affinity, risk and cohorts.

Each function takes the loan table and returns a lazy DataFrame; those that start from
customers also take stored states (`states.CustomerStates`) or a bucketed book
(`book.BucketedBook`) in its place. Means of customer
figures are plain means over customers, not weighted by their loans. `as_of` is the day
ages are counted to, today when None.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions import measures as m
from lendscope.functions.numbers import joined, label, pct, ratio, round_to
from lendscope.functions.rules import Points, RuleTable, Score, Test, rule
from lendscope.operators import categories as cat
from lendscope.operators.customer_grain import Source, customer_metrics, loan_rows
from lendscope.operators.median import brackets, inside, middle, side
from lendscope.operators.skew import HOT_ROWS, loan_sequence, with_previous_count
from lendscope.operators.states import CustomerStates
from lendscope.operators.topk import ranked, restrict_to_top

# Lower bound (exclusive) of the yearly value that earns each tier.
CLV_TIERS = ((50_000, "Platinum"), (30_000, "Gold"), (15_000, "Silver"))


# The rules overlap, the first one counts.
SEGMENTS = RuleTable(
    (
        rule("VIP - High Value", ("total_loans", ">=", 3), ("total_loss", "=", 0), ("avg_days_past_due", "=", 0)),
        rule("Premium - Good Standing", ("total_loans", ">=", 2), ("total_loss", "=", 0), ("avg_days_past_due", "<", 15)),
        rule("New - Performing", ("total_loans", "=", 1), ("total_loss", "=", 0), ("avg_days_past_due", "=", 0)),
        rule(
            "High Risk - Attention Needed",
            alternatives=([("total_loss", ">", 0)], [("avg_days_past_due", ">", 60)]),
        ),
        rule("At Risk - Monitor", ("avg_days_past_due", ">", 30)),
    ),
    "Standard - Regular",
)


def customer_segment(segments: RuleTable = SEGMENTS) -> Column:
    """The first segment whose rule a customer meets."""
    return segments.first()


def customer_segmentation(
    loans: Source, as_of: date | None = None, segments: RuleTable = SEGMENTS
) -> DataFrame:
    """Size, value, return and delinquency of each customer segment.

    The rules of `segments` may use any of the measures below."""
    customers = customer_metrics(
        loans,
        "total_loans",
        "total_borrowed",
        "avg_loan_size",
        "avg_risk_score",
        "first_loan_date",
        "total_revenue",
        "total_loss",
        "net_profit",
        "avg_days_past_due",
    )
    return (
        customers.withColumns(
            {
                "customer_segment": customer_segment(segments),
                "profitability_pct": pct(F.col("net_profit"), F.col("total_borrowed")),
                "tenure_days": m.days_since(F.col("first_loan_date"), as_of),
            }
        )
        .groupBy("customer_segment")
        .agg(
            m.loans().alias("customer_count"),
            F.sum("total_loans").alias("total_loans"),
            F.sum("total_borrowed").cast("double").alias("total_portfolio_value"),
            round_to(m.mean("total_borrowed"), 0).alias("avg_customer_value"),
            round_to(m.mean_of_means("avg_loan_size"), 0).alias("avg_loan_size"),
            round_to(m.mean_of_means("avg_risk_score"), 0).alias("avg_risk_score"),
            round_to(m.mean_of_means("tenure_days"), 0).alias("avg_tenure_days"),
            round_to(F.sum("total_revenue"), 2).alias("total_interest_income"),
            round_to(F.sum("total_loss"), 2).alias("total_loss"),
            round_to(m.mean_of_means("profitability_pct"), 2).alias("avg_profitability_pct"),
            round_to(m.mean_of_means("avg_days_past_due"), 1).alias("avg_days_past_due"),
        )
        .select(
            "customer_segment",
            "customer_count",
            m.share_of_rows("customer_count").alias("pct_of_customers"),
            "total_loans",
            "total_portfolio_value",
            "avg_customer_value",
            "avg_loan_size",
            "avg_risk_score",
            "avg_tenure_days",
            "total_interest_income",
            "total_loss",
            "avg_profitability_pct",
            "avg_days_past_due",
        )
        .orderBy(F.desc("total_portfolio_value"), "customer_segment")
    )


def clv_tier(value: Column, tiers: Sequence[tuple[int, str]] = CLV_TIERS) -> Column:
    return label([(value > floor, name) for floor, name in tiers], "Bronze")


def _top_by_value(loans: Source, n: int | None) -> tuple[Source, list[Column]]:
    """The loans of the `n` customers of highest lifetime value, and their order."""
    order = [F.desc("customer_lifetime_value"), F.asc("customer_id")]
    leaders = customer_metrics(loans, "net_profit").select(
        "customer_id", round_to(F.col("net_profit"), 2).alias("customer_lifetime_value")
    )
    return restrict_to_top(loans, leaders, order, n), order


def customer_clv(
    loans: Source, n: int | None = 50, tiers: Sequence[tuple[int, str]] = CLV_TIERS
) -> DataFrame:
    """Customers by lifetime value, interest income less actual loss, with their tier.

    `n` rows at most; all customers when `n` is None.
    """
    kept, order = _top_by_value(loans, n)
    customers = customer_metrics(
        kept,
        "total_loans",
        "total_borrowed",
        "avg_interest_rate",
        "avg_risk_score",
        "total_revenue",
        "total_loss",
        "net_profit",
        "first_loan_date",
        "last_loan_date",
        "avg_days_past_due",
        "loans_par_30",
        "products",
    ).withColumn("customer_lifetime_value", round_to(F.col("net_profit"), 2))
    clv = F.col("customer_lifetime_value")
    profiles = customers.select(
        "customer_id",
        "total_loans",
        F.col("total_borrowed").cast("double"),
        round_to(F.col("avg_interest_rate"), 2).alias("avg_interest_rate"),
        round_to(F.col("avg_risk_score"), 0).alias("avg_risk_score"),
        round_to(F.col("total_revenue"), 2).alias("total_interest_income"),
        round_to(F.col("total_loss"), 2).alias("total_actual_loss"),
        "customer_lifetime_value",
        pct(clv, F.col("total_borrowed")).alias("clv_margin_pct"),
        "first_loan_date",
        "last_loan_date",
        F.datediff("last_loan_date", "first_loan_date").cast("long").alias("relationship_duration_days"),
        "avg_days_past_due",
        F.col("loans_par_30").alias("delinquency_count"),
        F.size("products").cast("long").alias("products_used"),
        joined(F.col("products")).alias("product_mix"),
        clv_tier(clv, tiers).alias("clv_tier"),
    )
    return ranked(profiles, order, n)


def customer_retention(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """How customers' first, second, third ... loans compare, and how many get there.

    `hot_rows` is the number of loans beyond which a customer is worked on in slices.
    """
    needed = loans.select(
        "customer_id",
        "loan_id",
        "origination_date",
        "loan_amount",
        "risk_score",
        "days_past_due",
        "actual_loss",
    )
    growth = F.col("loan_amount") - F.col("previous_loan_amount")
    per_ordinal = (
        loan_sequence(needed, hot_rows)
        .withColumns(
            {
                "gap_days": F.datediff("origination_date", "previous_loan_date"),
                "growth_pct": pct(growth, F.col("previous_loan_amount")),
            }
        )
        .groupBy(F.col("loan_number").alias("customer_loan_sequence"))
        .agg(
            # A customer has at most one loan of each ordinal, so the distinct count of
            # customers is the count of non-NULL ones.
            F.count("customer_id").alias("customer_count"),
            round_to(m.mean_money("loan_amount"), 0).alias("avg_loan_amount"),
            round_to(m.mean_of_means("gap_days"), 0).alias("avg_days_between_loans"),
            round_to(m.mean_of_means("growth_pct"), 2).alias("avg_loan_growth_pct"),
            round_to(m.mean("risk_score"), 0).alias("avg_risk_score"),
            round_to(m.mean("days_past_due"), 1).alias("avg_days_past_due"),
            F.count_if(m.overdue()).alias("loans_par_30"),
            pct(F.count_if(m.overdue()), m.loans()).alias("par_30_rate_pct"),
            round_to(m.loss(), 2).alias("total_loss"),
        )
    )
    return (
        with_previous_count(per_ordinal, "customer_loan_sequence", "customer_count", "customers_before")
        .withColumn("retention_rate_pct", pct(F.col("customer_count"), F.col("customers_before")))
        .drop("customers_before")
        .orderBy("customer_loan_sequence")
    )


def risk_migration_pattern(first: Column, latest: Column) -> Column:
    """Direction of a change of tier; unknown or NULL tiers count as no change."""
    def moved(a: str, b: str) -> Column:
        return (first == a) & (latest == b)

    better = [("High", "Low"), ("High", "Medium"), ("Medium", "Low")]
    worse = [("Low", "High"), ("Medium", "High"), ("Low", "Medium")]
    return label(
        [(moved(a, b), f"Improved - {a} to {b}") for a, b in better]
        + [(moved(a, b), f"Deteriorated - {a} to {b}") for a, b in worse],
        "Stable - No Change",
    )


def risk_migration(loans: Source) -> DataFrame:
    """How repeat customers' risk tier and score moved from first to latest loan."""
    first, latest = F.col("first_risk"), F.col("latest_risk")
    return (
        customer_metrics(loans, "total_loans", "first_risk", "latest_risk")
        .where("total_loans > 1")
        .groupBy(
            risk_migration_pattern(first["risk_tier"], latest["risk_tier"]).alias("risk_migration_pattern")
        )
        .agg(
            m.loans().alias("customer_count"),
            round_to(m.mean_of_means(latest["risk_score"] - first["risk_score"]), 0).alias("avg_risk_score_change"),
            round_to(m.mean_of_means(first["risk_score"]), 0).alias("avg_initial_risk_score"),
            round_to(m.mean_of_means(latest["risk_score"]), 0).alias("avg_latest_risk_score"),
        )
        .select(
            "risk_migration_pattern",
            "customer_count",
            m.share_of_rows("customer_count").alias("pct_of_repeat_customers"),
            "avg_risk_score_change",
            "avg_initial_risk_score",
            "avg_latest_risk_score",
        )
        .orderBy(F.desc("customer_count"), "risk_migration_pattern")
    )


_TEXT_PARTS = {
    "total_loans": (m.loans, F.sum),
    "total_borrowed": (m.amount, F.sum),
    "total_revenue": (m.income, F.sum),
    "total_loss": (m.loss, F.sum),
    "first_loan_date": (lambda: F.min("origination_date"), F.min),
}
_TEXT_MEANS = ("interest_rate", "risk_score", "days_past_due")


def _over_text(loans: DataFrame, text: str, **more: Column) -> DataFrame:
    """One row per customer, by way of one row per customer and value of a text column.

    Loans are aggregated by both, with buffers of fixed width; sets and picks of the text
    then handle a few rows per customer instead of all loans, and any number of values.
    `more` are aggregates over `place` (the first loan with a value: its date and id) and
    the text.
    """
    parts = loans.groupBy("customer_id", text).agg(
        *(make().alias(name) for name, (make, _) in _TEXT_PARTS.items()),
        *(F.sum(name).alias(f"{name}_sum") for name in _TEXT_MEANS),
        *(F.count(name).alias(f"{name}_count") for name in _TEXT_MEANS),
        cat.first_place().alias("place"),
    )
    return parts.groupBy("customer_id").agg(
        *(merge(name).alias(name) for name, (_, merge) in _TEXT_PARTS.items()),
        *(
            ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_count")).alias(f"avg_{name}")
            for name in _TEXT_MEANS
        ),
        *(aggregate.alias(name) for name, aggregate in more.items()),
    )


# Names that make so few sets (65,536) that one task may see them all.
_FEW_NAMES = 16


def product_affinity(loans: Source, most_names: int = cat.MOST_NAMES) -> DataFrame:
    """Customers, value and margin of each combination of products held.

    Up to `most_names` products, which a job over their column looks up first, sets are bits;
    more products are aggregated by customer and text.
    """
    figures = (
        "total_loans",
        "total_borrowed",
        "avg_interest_rate",
        "total_revenue",
        "total_loss",
        "avg_days_past_due",
    )
    products = None
    keys, held = ["held"], F.col("held")
    if isinstance(loans, CustomerStates):
        customers = customer_metrics(loans, *figures, "products").withColumnRenamed("products", "held")
    elif (products := cat.coded(loan_rows(loans), "product_type", most_names)) is None:
        customers = _over_text(loan_rows(loans), "product_type", held=m.distinct_values("product_type"))
    else:
        masks = products.masks()
        customers = customer_metrics(loans, *figures, **masks)
        keys, held = list(masks), products.held()
    sets = customers.groupBy(*keys).agg(
        m.loans().alias("customer_count"),
        F.sum("total_loans").alias("total_loans"),
        F.sum("total_borrowed").cast("double").alias("total_portfolio_value"),
        round_to(m.mean("total_borrowed"), 0).alias("avg_customer_value"),
        round_to(m.mean_of_means("avg_interest_rate"), 2).alias("avg_interest_rate"),
        round_to(F.sum("total_revenue"), 2).alias("total_revenue"),
        round_to(F.sum("total_loss"), 2).alias("total_loss"),
        _margin().alias("net_margin_pct"),
        round_to(m.mean_of_means("avg_days_past_due"), 1).alias("avg_days_past_due"),
    )
    if products is not None and len(products.names) <= _FEW_NAMES:
        share = m.share_of_rows("customer_count")
    else:
        # There may be nearly as many sets as customers, so their total is an aggregate, not a
        # window that takes all of them to one task.
        share = pct(F.col("customer_count"), sets.agg(F.sum("customer_count")).scalar())
    return sets.withColumn("held", held).select(
        joined(F.col("held")).alias("product_combination"),
        F.size("held").cast("long").alias("number_of_products"),
        "customer_count",
        share.alias("pct_of_customers"),
        "total_loans",
        "total_portfolio_value",
        "avg_customer_value",
        "avg_interest_rate",
        "total_revenue",
        "total_loss",
        "net_margin_pct",
        "avg_days_past_due",
    ).orderBy(F.desc("customer_count"), "product_combination")


def _margin() -> Column:
    return pct(F.sum("total_revenue") - F.sum("total_loss"), F.sum("total_borrowed"))


def channel_acquisition(
    loans: Source, as_of: date | None = None, most_names: int = cat.MOST_NAMES
) -> DataFrame:
    """Customers by the channel of their first loan, and what became of them.

    Channels are coded like the products of `product_affinity`.
    """
    figures = (
        "total_loans",
        "total_borrowed",
        "total_revenue",
        "total_loss",
        "first_loan_date",
        "avg_risk_score",
        "avg_days_past_due",
    )
    if isinstance(loans, CustomerStates):
        customers = customer_metrics(loans, *figures, "first_channel", "channels").withColumn(
            "channels", F.size("channels")
        )
    elif (channels := cat.coded(loan_rows(loans), "channel", most_names)) is None:
        customers = _over_text(
            loan_rows(loans),
            "channel",
            first_channel=F.min_by("channel", "place"),
            channels=F.count("channel"),
        )
    else:
        customers = customer_metrics(
            loans, *figures, first=channels.first(), **channels.masks()
        ).withColumns(
            {"first_channel": channels.name_of_first(F.col("first")), "channels": channels.size()}
        )
    customers = customers.withColumn("age_days", m.days_since(F.col("first_loan_date"), as_of))
    multi_channel = F.count_if(F.col("channels") > 1)
    return (
        customers.groupBy("first_channel")
        .agg(
            m.loans().alias("customers_acquired"),
            F.sum("total_loans").alias("total_loans"),
            round_to(m.mean_of_means("total_loans"), 2).alias("avg_loans_per_customer"),
            F.sum("total_borrowed").cast("double").alias("total_portfolio_value"),
            round_to(m.mean("total_borrowed"), 0).alias("avg_customer_value"),
            round_to(m.mean_of_means("avg_risk_score"), 0).alias("avg_risk_score"),
            round_to(F.sum("total_revenue"), 2).alias("total_revenue"),
            round_to(F.sum("total_loss"), 2).alias("total_loss"),
            _margin().alias("net_margin_pct"),
            round_to(m.mean_of_means("avg_days_past_due"), 1).alias("avg_days_past_due"),
            round_to(m.mean_of_means("age_days"), 0).alias("avg_customer_age_days"),
            multi_channel.alias("multi_channel_customers"),
            pct(multi_channel, m.loans()).alias("multi_channel_pct"),
        )
        .select(
            F.col("first_channel").alias("acquisition_channel"),
            "customers_acquired",
            m.share_of_rows("customers_acquired").alias("pct_of_customers"),
            "total_loans",
            "avg_loans_per_customer",
            "total_portfolio_value",
            "avg_customer_value",
            "avg_risk_score",
            "total_revenue",
            "total_loss",
            "net_margin_pct",
            "avg_days_past_due",
            "avg_customer_age_days",
            "multi_channel_customers",
            "multi_channel_pct",
        )
        .orderBy(F.desc("total_portfolio_value"), "acquisition_channel")
    )


# Flag, and the words that report it, in the order they are joined.
WARNING_TEXTS = {
    "flag_high_dpd": "High DPD, ",
    "flag_par_30": "PAR 30+, ",
    "flag_has_loss": "Has Loss, ",
    "flag_high_risk_score": "High Risk Score, ",
    "flag_frequent_arrears": "Frequent Arrears",
}
WARNING_MEASURES = (
    "total_loans",
    "max_risk_score",
    "avg_days_past_due",
    "loans_with_arrears",
    "loans_par_30",
    "total_loss",
)


def warning_flags(
    mean_dpd: int = 30, risk_score: int = 700, arrears_share: float = 0.5
) -> dict[str, Column]:
    """0/1 warning signs of a customer, over `WARNING_MEASURES`."""
    signs = {
        "flag_high_dpd": F.col("avg_days_past_due") > mean_dpd,
        "flag_par_30": F.col("loans_par_30") > 0,
        "flag_has_loss": F.col("total_loss") > 0,
        "flag_high_risk_score": F.col("max_risk_score") > risk_score,
        "flag_frequent_arrears": ratio(F.col("loans_with_arrears"), F.col("total_loans")) > arrears_share,
    }
    return {name: F.when(sign, 1).otherwise(0) for name, sign in signs.items()}


def flag_total() -> Column:
    return reduce(add, map(F.col, WARNING_TEXTS)).cast("long")


def flag_texts() -> Column:
    """The raised flags in words. All but the last bring their separator along."""
    return F.concat(
        *(F.when(F.col(flag) == 1, text).otherwise("") for flag, text in WARNING_TEXTS.items())
    )


# What a number of raised flags is called.
WARNING_CATEGORIES = RuleTable(
    (
        rule("Critical - Immediate Action", ("total_risk_flags", ">=", 4)),
        rule("High Risk - Urgent Attention", ("total_risk_flags", "=", 3)),
        rule("Medium Risk - Monitor Closely", ("total_risk_flags", "=", 2)),
        rule("Low Risk - Watch", ("total_risk_flags", "=", 1)),
    ),
    "Healthy - No Action",
)


def warning_category(categories: RuleTable = WARNING_CATEGORIES) -> Column:
    """The category of a customer with `total_risk_flags`."""
    return categories.first()


def early_warning(
    loans: Source,
    as_of: date | None = None,
    n: int | None = 100,
    mean_dpd: int = 30,
    risk_score: int = 700,
    arrears_share: float = 0.5,
    categories: RuleTable = WARNING_CATEGORIES,
) -> DataFrame:
    """Customers with at least one warning flag, most flags and largest exposure first.

    `n` rows at most; all flagged customers when `n` is None. The next three are the limits
    of `warning_flags`; the rules of `categories` may use the flags and their total.
    """
    order = [F.desc("total_risk_flags"), F.desc("total_borrowed"), F.asc("customer_id")]

    def flagged(source: Source, *more: str) -> DataFrame:
        return (
            customer_metrics(source, *WARNING_MEASURES, "total_borrowed", *more)
            .withColumns(warning_flags(mean_dpd, risk_score, arrears_share))
            .withColumn("total_risk_flags", flag_total())
            .where("total_risk_flags > 0")
        )

    kept = loans if n is None else restrict_to_top(loans, flagged(loans), order, n)
    customers = flagged(kept, "avg_risk_score", "max_days_past_due", "last_loan_date", "products", "statuses")
    return ranked(customers, order, n).select(
        "customer_id",
        "total_loans",
        F.col("total_borrowed").cast("double").alias("total_exposure"),
        "avg_risk_score",
        "max_risk_score",
        "avg_days_past_due",
        "max_days_past_due",
        "loans_with_arrears",
        "loans_par_30",
        F.col("total_loss").cast("double"),
        "last_loan_date",
        m.days_since(F.col("last_loan_date"), as_of).alias("days_since_last_loan"),
        joined(F.col("products")).alias("products"),
        joined(F.col("statuses")).alias("loan_statuses"),
        "total_risk_flags",
        warning_category(categories).alias("risk_category"),
        flag_texts().alias("risk_indicators"),
    )


# What to do about each quadrant of value and risk.
STRATEGIES = {
    ("High Value", "Low Risk"): "GROW - Invest & Expand",
    ("High Value", "High Risk"): "MANAGE - Monitor & Protect",
    ("Low Value", "Low Risk"): "DEVELOP - Upsell & Cross-sell",
    ("Low Value", "High Risk"): "DIVEST - Minimize Exposure",
}


def strategic_action(value: Column, risk: Column) -> Column:
    return label([((value == v) & (risk == r), action) for (v, r), action in STRATEGIES.items()])


def profitability_matrix(loans: Source, risky_dpd: int = 15) -> DataFrame:
    """Customers in quadrants of value and risk, split at the exact medians.

    Two passes over the customers: one for brackets of the medians, one that sums customers by
    the side of both brackets they lie on. Those inside a bracket, which are few, stay apart by
    value, so the medians and the quadrants both follow from these sums.
    """
    customers = customer_metrics(
        loans,
        "total_loans",
        "total_borrowed",
        "avg_risk_score",
        "total_revenue",
        "total_loss",
        "net_profit",
        "avg_days_past_due",
    )
    split = {"value": F.col("net_profit").cast("double"), "risk": F.col("avg_risk_score")}
    found = brackets(customers, "net_profit", "avg_risk_score")
    bracket = {"value": F.col("brackets.net_profit"), "risk": F.col("brackets.avg_risk_score")}
    cells = (
        customers.withColumn("brackets", found)
        .groupBy(
            *(side(split[name], bracket[name]).alias(f"{name}_side") for name in split),
            *(inside(split[name], bracket[name]).alias(name) for name in split),
            F.coalesce(F.col("avg_days_past_due") > risky_dpd, F.lit(False)).alias("late"),
        )
        .agg(
            m.loans().alias("customer_count"),
            *(F.sum(name).alias(name) for name in ("total_loans", "total_borrowed", "total_revenue")),
            *(F.sum(name).alias(name) for name in ("total_loss", "net_profit")),
            *(m.exact_mean(name).alias(name) for name in ("avg_risk_score", "avg_days_past_due")),
        )
    )
    middles = {
        f"{name}_middle": middle(F.col(f"{name}_side"), F.col(name), F.col("customer_count")) for name in split
    }

    def high(name: str) -> Column:
        of_side = F.col(f"{name}_side")
        return (of_side == 1) | ((of_side == 0) & (F.col(name) >= F.col(f"{name}_middle")))

    return (
        cells.withColumns(middles)
        .withColumns(
            {
                "value_segment": F.when(high("value"), "High Value").otherwise("Low Value"),
                "risk_segment": F.when(high("risk") | F.col("late"), "High Risk").otherwise("Low Risk"),
            }
        )
        .groupBy("value_segment", "risk_segment")
        .agg(
            F.sum("customer_count").alias("customer_count"),
            F.sum("total_loans").alias("total_loans"),
            F.sum("total_borrowed").alias("total_borrowed"),
            m.merged_mean("avg_risk_score").alias("avg_risk_score"),
            F.sum("total_revenue").alias("total_revenue"),
            F.sum("total_loss").alias("total_loss"),
            F.sum("net_profit").alias("net_profit"),
            m.merged_mean("avg_days_past_due").alias("avg_days_past_due"),
        )
        .select(
            F.concat_ws(" / ", "value_segment", "risk_segment").alias("customer_quadrant"),
            "customer_count",
            m.share_of_rows("customer_count").alias("pct_of_customers"),
            "total_loans",
            F.col("total_borrowed").cast("double").alias("total_portfolio_value"),
            round_to(ratio(F.col("total_borrowed"), F.col("customer_count")), 0).alias("avg_customer_value"),
            round_to(F.col("avg_risk_score"), 0).alias("avg_risk_score"),
            round_to(F.col("total_revenue"), 2).alias("total_revenue"),
            round_to(F.col("total_loss"), 2).alias("total_loss"),
            round_to(F.col("net_profit"), 2).alias("total_net_profit"),
            round_to(ratio(F.col("net_profit"), F.col("customer_count")), 0).alias("avg_profit_per_customer"),
            round_to(F.col("avg_days_past_due"), 1).alias("avg_days_past_due"),
            strategic_action(F.col("value_segment"), F.col("risk_segment")).alias("strategic_action"),
        )
        .orderBy(F.desc("total_net_profit"), "customer_quadrant")
    )


def acquisition_cohorts(loans: Source, as_of: date | None = None) -> DataFrame:
    """Customers by the month of their first loan, and how each cohort performs.

    Loans without a customer belong to no cohort, and loans without an id are not counted.
    """
    customers = customer_metrics(
        loans,
        "first_loan_date",
        "total_borrowed",
        "avg_risk_score",
        "total_revenue",
        "total_loss",
        "avg_days_past_due",
        "loans_par_30",
        "counted_loans",
    ).where("customer_id is not null").withColumn("age_days", m.days_since(F.col("first_loan_date"), as_of))
    return (
        customers.groupBy(m.month_of(F.col("first_loan_date")).alias("cohort_month"))
        .agg(
            m.loans().alias("customers_acquired"),
            F.sum("counted_loans").alias("total_loans"),
            round_to(m.mean_of_means("counted_loans"), 2).alias("avg_loans_per_customer"),
            F.sum("total_borrowed").cast("double").alias("total_portfolio_value"),
            round_to(m.mean("total_borrowed"), 0).alias("avg_customer_value"),
            round_to(m.mean_of_means("avg_risk_score"), 0).alias("avg_risk_score"),
            round_to(F.sum("total_revenue"), 2).alias("total_revenue"),
            round_to(F.sum("total_loss"), 2).alias("total_loss"),
            _margin().alias("net_margin_pct"),
            round_to(m.mean_of_means("avg_days_past_due"), 1).alias("avg_days_past_due"),
            F.sum("loans_par_30").alias("total_loans_par_30"),
            pct(F.sum("loans_par_30"), F.sum("counted_loans")).alias("par_30_rate_pct"),
            round_to(m.mean_of_means("age_days"), 0).alias("avg_cohort_age_days"),
            pct(F.count_if(F.col("counted_loans") > 1), m.loans()).alias("repeat_customer_pct"),
        )
        .orderBy("cohort_month")
    )


HEALTH_MEASURES = ("avg_days_past_due", "loans_par_30", "total_loss", "total_loans", "products")


# What a customer's health gains and loses.
HEALTH = Score(
    100,
    (
        Points(Test("avg_days_past_due", ">", 0), -0.5, per="avg_days_past_due"),
        Points(Test("loans_par_30", ">", 0), -10, per="loans_par_30"),
        Points(Test("total_loss", ">", 0), -20),
        Points(Test("total_loans", ">", 2), 10),
        Points(Test("size(products)", ">", 1), 5),
    ),
)


def health_score(health: Score = HEALTH) -> Column:
    """A rule-based score around 100, over `HEALTH_MEASURES`; it is not clamped."""
    return round_to(health.value(), 0)


def top_customers(
    loans: Source, as_of: date | None = None, n: int | None = 30, health: Score = HEALTH
) -> DataFrame:
    """Full profile of the customers of highest lifetime value.

    `n` rows at most; all customers when `n` is None. The terms of `health` may use any of the
    measures below.
    """
    kept, order = _top_by_value(loans, n)
    customers = customer_metrics(
        kept,
        "total_loans",
        "first_loan_date",
        "last_loan_date",
        "total_borrowed",
        "avg_loan_size",
        "min_loan_size",
        "max_loan_size",
        "avg_interest_rate",
        "total_revenue",
        "total_loss",
        "net_profit",
        "avg_risk_score",
        "min_risk_score",
        "max_risk_score",
        "avg_days_past_due",
        "max_days_past_due",
        "loans_with_arrears",
        "loans_par_30",
        "products",
        "channels",
        "tiers",
        "statuses",
    )
    profiles = customers.select(
        "customer_id",
        "total_loans",
        "first_loan_date",
        "last_loan_date",
        F.datediff("last_loan_date", "first_loan_date").cast("long").alias("relationship_duration_days"),
        m.days_since(F.col("first_loan_date"), as_of).alias("customer_tenure_days"),
        F.col("total_borrowed").cast("double"),
        round_to(F.col("avg_loan_size"), 0).alias("avg_loan_size"),
        F.col("min_loan_size").cast("double"),
        F.col("max_loan_size").cast("double"),
        round_to(F.col("avg_interest_rate"), 2).alias("avg_interest_rate"),
        round_to(F.col("total_revenue"), 2).alias("total_revenue"),
        round_to(F.col("total_loss"), 2).alias("total_actual_loss"),
        round_to(F.col("net_profit"), 2).alias("customer_lifetime_value"),
        pct(F.col("net_profit"), F.col("total_borrowed")).alias("clv_margin_pct"),
        round_to(F.col("avg_risk_score"), 0).alias("avg_risk_score"),
        "min_risk_score",
        "max_risk_score",
        round_to(F.col("avg_days_past_due"), 1).alias("avg_days_past_due"),
        "max_days_past_due",
        "loans_with_arrears",
        "loans_par_30",
        F.size("products").cast("long").alias("unique_products"),
        F.size("channels").cast("long").alias("unique_channels"),
        joined(F.col("products")).alias("product_mix"),
        joined(F.col("channels")).alias("channel_mix"),
        joined(F.col("tiers")).alias("risk_tiers"),
        joined(F.col("statuses")).alias("loan_statuses"),
        health_score(health).alias("customer_health_score"),
    )
    return ranked(profiles, order, n)
