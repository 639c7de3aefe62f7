"""Hand-made rows: edges, NULLs, ties and order of the portfolio views."""

from datetime import date

from lendscope.operators import portfolio as p
from tests.conftest import by


def test_overview_of_no_loans(make_loans):
    row = p.portfolio_overview(make_loans()).first().asDict()
    counts = {k for k in row if k.endswith("_loans") or k.startswith("loans_") or k.startswith("total_cust")}
    assert all(row[k] == 0 for k in counts)
    assert all(v is None for k, v in row.items() if k not in counts)


def test_overview_thresholds_are_strict(make_loans):
    row = p.portfolio_overview(
        make_loans(*({"days_past_due": d} for d in (0, 1, 30, 31, 60, 61, 90, 91)))
    ).first()
    assert [row[f"loans_{k}"] for k in ("in_arrears", "par_30", "par_60", "par_90")] == [7, 5, 3, 1]
    assert [row[f"amount_{k}"] for k in ("in_arrears", "par_30", "par_60", "par_90")] == [7e3, 5e3, 3e3, 1e3]
    assert row["par_30_rate_pct"] == 62.5


def test_overview_counts_loans_distinctly_but_arrears_by_row(make_loans):
    row = p.portfolio_overview(
        make_loans({"loan_id": 5, "days_past_due": 10}, {"loan_id": 5, "days_past_due": 10})
    ).first()
    assert (row["total_loans"], row["loans_in_arrears"], row["arrears_rate_pct"]) == (1, 2, 200.0)


def test_overview_status_groups(make_loans):
    statuses = ["Active", "Closed", "Defaulted", "Written Off", "In Collection", None]
    row = p.portfolio_overview(make_loans(*({"status": s} for s in statuses))).first()
    assert (row["active_loans"], row["closed_loans"], row["defaulted_loans"]) == (1, 1, 1)
    assert (row["non_performing_loans"], row["non_performing_value"]) == (2, 2000.0)


def test_buckets_and_tiers_come_in_order_with_the_unknown_last(make_loans):
    names = ["PAR 90+", "mystery", "Current", "PAR 61-90", "PAR 1-30", "PAR 31-60"]
    rows = p.par_bucket_distribution(make_loans(*({"par_bucket": n} for n in names))).collect()
    assert [r["par_bucket"] for r in rows] == [*p.PAR_BUCKETS, "mystery"]
    rows = p.risk_tier_profitability(
        make_loans(*({"risk_tier": t} for t in ("odd", "High", "Low", "Medium")))
    ).collect()
    assert [r["risk_tier"] for r in rows] == ["Low", "Medium", "High", "odd"]


def test_tier_profit(make_loans):
    row = p.risk_tier_profitability(
        make_loans({"loan_amount": "1000.10", "interest_rate": "20.55", "actual_loss": "5.25"})
    ).first()
    assert row["estimated_interest_income"] == 205.52
    assert row["net_return_pct"] == 20.03


def test_rates_over_nothing_are_null(make_loans):
    row = p.product_performance(make_loans({"loan_amount": 0})).first()
    assert (row["par_30_rate_pct"], row["loss_rate_pct"], row["net_return_pct"]) == (None, None, None)
    row = p.risk_score_validation(make_loans({"expected_loss": 0, "actual_loss": 5})).first()
    assert row["loss_variance_pct"] is None


def test_products_by_value_then_name(make_loans):
    rows = p.product_performance(
        make_loans(
            {"product_type": "B"},
            {"product_type": "A"},
            {"product_type": "C", "loan_amount": 2000},
        )
    ).collect()
    assert [r["product_type"] for r in rows] == ["C", "A", "B"]


def test_months(make_loans):
    rows = p.monthly_origination_trend(
        make_loans(
            {"origination_date": "2024-02-29"},
            {"origination_date": "2023-12-31", "days_past_due": 31},
            {"origination_date": "2023-12-01", "loan_amount": 3000},
        )
    ).collect()
    assert [(r["origination_month"], r["loans_originated"], r["par_30_rate_pct"]) for r in rows] == [
        ("2023-12", 2, 25.0),
        ("2024-02", 1, 0.0),
    ]


def test_score_bands(make_loans):
    scores = [599, 600, 649, 650, 699, 700, 701, 749, 750, None]
    rows = p.risk_score_validation(make_loans(*({"risk_score": s} for s in scores))).collect()
    assert [(r["risk_score_band"], r["loan_count"]) for r in rows] == [
        ("< 600", 1),
        ("600-649", 2),
        ("650-699", 2),
        ("700-749", 3),
        ("750+", 2),
    ]


def test_status_shares(make_loans):
    rows = by("status", p.loan_status_breakdown(make_loans({}, {}, {"status": "Closed", "loan_amount": 2000})))
    assert (rows["Active"]["pct_of_total_loans"], rows["Closed"]["pct_of_total_loans"]) == (66.67, 33.33)
    assert rows["Closed"]["pct_of_total_amount"] == 50.0


def test_high_risk_filter_order_and_cut(make_loans):
    loans = make_loans(
        {"loan_id": 1, "risk_tier": "High"},
        {"loan_id": 2, "days_past_due": 61},
        {"loan_id": 3, "days_past_due": 91, "loan_amount": 10},
        {"loan_id": 4, "actual_loss": "0.01", "loan_amount": 0},
        {"loan_id": 5, "days_past_due": 60},
        {"loan_id": 7, "days_past_due": 31, "risk_tier": "High"},
        {"loan_id": 6, "days_past_due": 31, "risk_tier": "High"},
        {"loan_id": 8, "risk_tier": None, "actual_loss": None},
    )
    rows = p.high_risk_loans(loans).collect()
    assert [r["loan_id"] for r in rows] == [3, 2, 6, 7, 1, 4]
    assert rows[-1]["loss_rate_pct"] is None
    assert [r["loan_id"] for r in p.high_risk_loans(loans, n=2).collect()] == [3, 2]
    assert rows[0]["origination_date"] == date(2024, 1, 1)


def test_concentration(make_loans):
    loans = make_loans(
        {"customer_id": 1, "risk_tier": "High"},
        {"customer_id": 1, "risk_tier": "Medium"},
        {"customer_id": 2, "risk_tier": "High", "loan_amount": 1500},
        {"customer_id": 2, "risk_tier": "Low", "loan_amount": 1500, "days_past_due": 31},
        {"customer_id": 3, "loan_amount": 4000},
        {"customer_id": None},
        {"customer_id": None},
    )
    rows = p.portfolio_concentration(loans).collect()
    assert [r["customer_id"] for r in rows] == [2, None, 1]
    assert [r["highest_risk_tier"] for r in rows] == ["Low", "Low", "Medium"]
    assert [r["loans_par_30_plus"] for r in rows] == [1, 0, 0]
    assert rows[0]["pct_of_portfolio"] == round(3000 * 100 / 11000, 2)
    cut = p.portfolio_concentration(loans, n=2).collect()
    assert cut == rows[:2]
    worst = loans.groupBy("customer_id").agg(p.worst_risk_tier().alias("worst"))
    assert by("customer_id", worst)[1]["worst"] == "High"


def test_sums_are_exact_for_negative_large_and_fractional_money(spark, make_loans):
    from lendscope.functions import measures as m

    loans = make_loans(
        {"loan_amount": "9999999999999999.99", "interest_rate": 0},
        {"loan_amount": "-0.01", "interest_rate": 0},
        {"loan_amount": "90000000000000.07", "interest_rate": 0},
        {"loan_amount": "1.15", "interest_rate": "20.55"},
    )
    row = loans.agg(m.amount().alias("amount"), m.income().alias("income")).first()
    assert str(row["amount"]) == "10090000000000001.20"
    assert str(row["income"]) == "0.236325"
