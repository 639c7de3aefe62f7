"""Facts that hold for any loan table, and the known shape of the derived one."""

import pytest
from pyspark.sql import functions as F

from lendscope.plans.catalog import CATALOG
from lendscope.sources.loans import load_loans
from tests.conftest import ORACLE_DIR, by


@pytest.fixture(scope="module")
def loans(spark):
    return load_loans(spark, ORACLE_DIR)


@pytest.fixture(scope="module")
def totals(loans):
    return loans.agg(
        F.count("*").alias("loans"), F.count_distinct("customer_id").alias("customers")
    ).first()


def total(df, column):
    return sum(row[column] for row in df.collect())


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("par_bucket_distribution", "loan_count"),
        ("risk_tier_profitability", "loan_count"),
        ("product_performance", "loan_count"),
        ("monthly_origination_trend", "loans_originated"),
        ("channel_performance", "loan_count"),
        ("loan_status_breakdown", "loan_count"),
        ("risk_score_validation", "loan_count"),
        ("customer_segmentation", "total_loans"),
        ("acquisition_cohorts", "total_loans"),
    ],
)
def test_groups_cover_all_loans(loans, totals, name, column):
    assert total(CATALOG[name](loans), column) == totals["loans"]


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("customer_segmentation", "customer_count"),
        ("product_affinity", "customer_count"),
        ("channel_acquisition", "customers_acquired"),
        ("profitability_matrix", "customer_count"),
        ("acquisition_cohorts", "customers_acquired"),
    ],
)
def test_groups_cover_all_customers(loans, totals, name, column):
    assert total(CATALOG[name](loans), column) == totals["customers"]


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("loan_status_breakdown", "pct_of_total_loans"),
        ("loan_status_breakdown", "pct_of_total_amount"),
        ("customer_segmentation", "pct_of_customers"),
        ("risk_migration", "pct_of_repeat_customers"),
        ("product_affinity", "pct_of_customers"),
        ("channel_acquisition", "pct_of_customers"),
        ("profitability_matrix", "pct_of_customers"),
    ],
)
def test_shares_sum_to_a_hundred(loans, name, column):
    assert total(CATALOG[name](loans), column) == pytest.approx(100, abs=0.1)


def test_overview_ladders(loans):
    row = CATALOG["portfolio_overview"](loans).first()
    ladder = [row[f"loans_{k}"] for k in ("in_arrears", "par_30", "par_60", "par_90")]
    assert ladder == sorted(ladder, reverse=True)
    assert row["low_risk_loans"] + row["medium_risk_loans"] + row["high_risk_loans"] == row["total_loans"]


def test_retention_never_grows(loans):
    counts = [r["customer_count"] for r in CATALOG["customer_retention"](loans).collect()]
    assert counts == sorted(counts, reverse=True)


def test_known_counts(loans):
    segments = by("customer_segment", CATALOG["customer_segmentation"](loans))
    assert {k.split(" - ")[0]: v["customer_count"] for k, v in segments.items()} == {
        "VIP": 226,
        "Premium": 2416,
        "New": 618,
        "High Risk": 959,
        "At Risk": 106,
        "Standard": 1157,
    }
    buckets = by("par_bucket", CATALOG["par_bucket_distribution"](loans))
    assert [b["loan_count"] for b in buckets.values()] == [7525, 5574, 884, 592, 425]
    flags = CATALOG["early_warning_all"](loans).groupBy("total_risk_flags").count()
    assert {r[0]: r[1] for r in flags.collect()} == {1: 2281, 2: 1112, 3: 497, 4: 431, 5: 315}
    tiers = CATALOG["customer_clv_all"](loans).groupBy("clv_tier").count()
    assert {r[0]: r[1] for r in tiers.collect()} == {"Platinum": 4495, "Gold": 445, "Silver": 296, "Bronze": 246}
    assert total(CATALOG["risk_migration"](loans), "customer_count") == 4227


@pytest.mark.parametrize(
    "name",
    ["high_risk_loans", "portfolio_concentration", "customer_clv", "early_warning", "top_customers"],
)
def test_a_cut_list_is_the_head_of_the_uncut_one(loans, name):
    cut = CATALOG[name](loans).collect()
    assert cut == CATALOG[f"{name}_all"](loans).limit(len(cut)).collect()
