"""Rule tables, and the views whose limits are theirs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendscope.functions.rules import Points, RuleTable, Score, Test, rule
from lendscope.operators import customer as c
from lendscope.operators import portfolio as p
from tests.conftest import by

TODAY = date(2026, 4, 23)

TABLE = RuleTable(
    (
        rule("both", ("a", ">", 1), ("b", "<=", 5)),
        rule("either", alternatives=([("a", "=", 0)], [("b", ">", 90), ("a", "<>", 3)])),
        rule("listed", ("c", "in", ("x", "y"))),
        rule("sum", ("a + b", ">=", 10)),
    ),
    "rest",
)


def named(spark, *rows):
    df = spark.createDataFrame(rows, "a int, b int, c string")
    return [tuple(r) for r in df.select(TABLE.first(), TABLE.any(), TABLE.all_names()).collect()]


def test_first_rule_counts_and_edges(spark):
    got = named(spark, (2, 5, "x"), (1, 5, "x"), (2, 6, "z"), (0, 1, "y"), (3, 91, "z"), (4, 91, "y"), (4, 6, "z"), (1, 1, "q"))
    assert [g[0] for g in got] == ["both", "listed", "rest", "either", "sum", "either", "sum", "rest"]
    assert got[3][2] == ["either", "listed"] and got[5][2] == ["either", "listed", "sum"]
    assert got[-1] == ("rest", False, [])


def test_nulls_fall_through(spark):
    got = named(spark, (None, 5, "x"), (None, None, None), (0, None, None), (None, 91, None))
    assert [g[0] for g in got] == ["listed", "rest", "either", "rest"]
    assert [g[1] for g in got] == [True, None, True, None]


def test_bad_tables_are_refused(spark):
    with pytest.raises(ValueError, match="no comparison"):
        rule("x", ("a", "~", 1)).holds()
    with pytest.raises(ValueError, match="without tests"):
        rule("x").holds()
    with pytest.raises(ValueError, match="same name"):
        RuleTable((rule("x", ("a", ">", 1)), rule("x", ("a", ">", 2)))).first()
    assert spark.range(1).select(RuleTable((), "d").first(), RuleTable(()).any()).first() == ("d", False)


def test_points(spark):
    score = Score(10, (Points(Test("a", ">", 0), -2, per="a"), Points(Test("b", ">=", 5), 3.5)))
    df = spark.createDataFrame([(3, 5), (0, 4), (None, None), (-1, 6)], "a int, b int")
    assert [r[0] for r in df.select(score.value()).collect()] == [7.5, 10.0, 10.0, 13.5]


def test_segments_of_ones_own(make_loans):
    loans = make_loans({"customer_id": 1, "days_past_due": 40}, {"customer_id": 2}, {"customer_id": 2}, {"customer_id": None, "risk_score": None})
    own = RuleTable((rule("Late", ("avg_days_past_due", ">=", 40)), rule("Repeat", ("total_loans", ">", 1))), "Other")
    assert {k: r["customer_count"] for k, r in by("customer_segment", c.customer_segmentation(loans, TODAY, own)).items()} == {
        "Late": 1, "Repeat": 1, "Other": 1,
    }
    default = by("customer_segment", c.customer_segmentation(loans, TODAY))
    assert set(default) == {"At Risk - Monitor", "Premium - Good Standing", "New - Performing"}


def test_warning_categories_of_ones_own(make_loans):
    loans = make_loans({"customer_id": 1, "days_past_due": 40, "actual_loss": 5}, {"customer_id": 2, "risk_score": 720})
    own = RuleTable((rule("Loss", ("flag_has_loss", "=", 1)),), "No loss")
    got = by("customer_id", c.early_warning(loans, TODAY, categories=own))
    assert (got[1]["risk_category"], got[2]["risk_category"]) == ("Loss", "No loss")
    assert by("customer_id", c.early_warning(loans, TODAY))[1]["risk_category"] == "Critical - Immediate Action"


def test_health_of_ones_own(make_loans):
    loans = make_loans({"customer_id": 1, "days_past_due": 41}, {"customer_id": 1, "product_type": "POS"})
    assert c.top_customers(loans, TODAY).first()["customer_health_score"] == round(100 - 20.5 * 0.5 - 10 + 5 + 1e-9)
    own = Score(50, (Points(Test("max_days_past_due", ">", 40), -7), Points(Test("size(channels)", "=", 1), 1, per="total_loans")))
    assert c.top_customers(loans, TODAY, health=own).first()["customer_health_score"] == 45


def test_ladder_of_ones_own(make_loans):
    loans = make_loans({"days_past_due": 5}, {"days_past_due": 15, "loan_amount": 3000}, {"days_past_due": None}, {"days_past_due": 46})
    row = p.portfolio_overview(loans, ladder=(10, 15, 45)).first().asDict()
    assert (row["loans_par_10"], row["loans_par_15"], row["loans_par_45"]) == (2, 1, 1)
    assert (row["arrears_rate_pct"], row["par_rate_pct"], row["par_15_rate_pct"]) == (50.0, 66.67, 16.67)
    assert "loans_par_30" not in row and len(row) == 41
    with pytest.raises(ValueError, match="rises"):
        p.portfolio_overview(loans, ladder=(30, 10))


def test_high_risk_of_ones_own(make_loans):
    loans = make_loans(
        {"loan_id": 1, "risk_tier": "High"}, {"loan_id": 2, "risk_score": 800, "loan_amount": 5}, {"loan_id": 3, "days_past_due": 100},
        {"loan_id": 4, "risk_score": 800, "channel": "Agent"}, {"loan_id": 5, "risk_score": None},
    )
    own = RuleTable((rule("score", ("risk_score", ">", 750)),))
    classes = RuleTable((rule(1, ("loan_amount", "<", 100)),), 2)
    assert [r["loan_id"] for r in p.high_risk_loans(loans, rules=own, classes=classes).collect()] == [2, 4]
    assert [r["loan_id"] for r in p.high_risk_loans(loans).collect()] == [3, 1]


def test_profiles_agree_over_dimensions(make_loans):
    loans = make_loans({"channel": "A"}, {"channel": "B", "loan_amount": 9}, {"channel": None, "interest_rate": 2})
    rows = p.profile(loans, "channel", late=F.count_if(F.col("days_past_due") > 0)).collect()
    whole = p.profile(loans, F.lit("all").alias("dimension")).first()
    assert sum(r["portfolio_value"] for r in rows) == whole["portfolio_value"]
    assert sum(r["loan_count"] for r in rows) == whole["loan_count"] == 3
