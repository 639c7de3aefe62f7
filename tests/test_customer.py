"""Hand-made rows: rules, edges, NULLs and ties of the customer views."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendscope.functions import measures as m
from lendscope.operators import customer as c
from lendscope.operators.customer_grain import customer_metrics
from lendscope.operators import categories as cat
from lendscope.operators.median import brackets, exact_medians, inside
from tests.conftest import by

TODAY = date(2024, 3, 1)


def loans_of(customer, *rows, **common):
    return [{"customer_id": customer, "loan_id": customer * 100 + i, **common, **r} for i, r in enumerate(rows)]


def test_segment_rules_and_their_order(make_loans):
    loans = make_loans(
        *loans_of(1, {}, {}, {}),
        *loans_of(2, {}, {}),
        *loans_of(3, {"days_past_due": 28}, {}),
        *loans_of(4, {}),
        *loans_of(5, {"actual_loss": 1}),
        *loans_of(6, {"days_past_due": 61}),
        *loans_of(7, {"days_past_due": 31}),
        *loans_of(8, {"days_past_due": 30}, {}),
        *loans_of(9, {"days_past_due": None}),
    )
    customers = customer_metrics(loans, "total_loans", "total_loss", "avg_days_past_due").select(
        "customer_id", c.customer_segment().alias("segment")
    )
    got = {k: v["segment"] for k, v in by("customer_id", customers).items()}
    assert got == {
        1: "VIP - High Value",
        2: "Premium - Good Standing",
        3: "Premium - Good Standing",
        4: "New - Performing",
        5: "High Risk - Attention Needed",
        6: "High Risk - Attention Needed",
        7: "At Risk - Monitor",
        8: "Standard - Regular",
        9: "Standard - Regular",
    }
    rows = by("customer_segment", c.customer_segmentation(loans, TODAY))
    assert sum(r["customer_count"] for r in rows.values()) == 9
    assert rows["VIP - High Value"]["avg_tenure_days"] == 60.0
    assert rows["Premium - Good Standing"]["pct_of_customers"] == 22.22


def test_segment_means_are_means_of_customers(make_loans):
    rows = c.customer_segmentation(
        make_loans(
            *loans_of(1, {"loan_amount": 100}, {"loan_amount": 100}), *loans_of(2, {"loan_amount": 400}, {"loan_amount": 600})
        ),
        TODAY,
    ).collect()
    assert [(r["avg_customer_value"], r["avg_loan_size"]) for r in rows] == [(600.0, 300.0)]


@pytest.mark.parametrize(
    ("value", "tier"),
    [
        ("50000.01", "Platinum"),
        ("50000.00", "Gold"),
        ("30000.00", "Silver"),
        ("15000.01", "Silver"),
        ("15000.00", "Bronze"),
    ],
)
def test_clv_tier_edges(make_loans, value, tier):
    row = c.customer_clv(make_loans({"loan_amount": value, "interest_rate": 100})).first()
    assert (row["customer_lifetime_value"], row["clv_tier"]) == (float(value), tier)


def test_clv_profile_ties_and_cut(make_loans):
    loans = make_loans(
        *loans_of(3, {"product_type": "SME", "origination_date": "2024-01-31"}, {"product_type": "POS"}),
        *loans_of(2, {}, {}),
        *loans_of(1, {"loan_amount": 0}),
    )
    rows = c.customer_clv(loans).collect()
    assert [r["customer_id"] for r in rows] == [2, 3, 1]
    assert (rows[1]["product_mix"], rows[1]["products_used"]) == ("POS, SME", 2)
    assert rows[1]["relationship_duration_days"] == 30
    assert rows[2]["clv_margin_pct"] is None
    assert c.customer_clv(loans, n=1).collect() == rows[:1]


def test_clv_of_a_null_customer_survives_the_cut(make_loans):
    rows = c.customer_clv(make_loans({"customer_id": None, "loan_amount": 9000}, {}), n=1).collect()
    assert [(r["customer_id"], r["total_borrowed"]) for r in rows] == [(None, 9000.0)]


def test_retention(make_loans):
    rows = c.customer_retention(
        make_loans(
            *loans_of(1, {}, {"origination_date": "2024-01-11", "loan_amount": 1500}),
            *loans_of(2, {"loan_amount": 0}, {"origination_date": "2024-01-31", "days_past_due": 31}),
            *loans_of(3, {}),
        )
    ).collect()
    first, second = rows
    assert (first["customer_loan_sequence"], first["customer_count"], first["retention_rate_pct"]) == (1, 3, None)
    assert (first["avg_days_between_loans"], first["avg_loan_growth_pct"]) == (None, None)
    assert (second["customer_count"], second["retention_rate_pct"]) == (2, 66.67)
    assert second["avg_days_between_loans"] == 20.0
    assert second["avg_loan_growth_pct"] == 50.0
    assert second["par_30_rate_pct"] == 50.0


def test_migration_patterns(make_loans):
    tiers = ["Low", "Medium", "High"]
    pairs = [(a, b) for a in tiers for b in tiers] + [(None, "High"), ("Low", "odd")]
    rows = []
    for i, (a, b) in enumerate(pairs, 1):
        rows += loans_of(i, {"risk_tier": a, "risk_score": 600}, {"risk_tier": b, "risk_score": 610})
    rows += loans_of(50, {"risk_tier": "High"})
    got = by("risk_migration_pattern", c.risk_migration(make_loans(*rows)))
    assert {k: v["customer_count"] for k, v in got.items()} == {
        "Stable - No Change": 5,
        "Improved - High to Low": 1,
        "Improved - High to Medium": 1,
        "Improved - Medium to Low": 1,
        "Deteriorated - Low to High": 1,
        "Deteriorated - Low to Medium": 1,
        "Deteriorated - Medium to High": 1,
    }
    assert all(v["avg_risk_score_change"] == 10.0 for v in got.values())


def test_same_day_loans_are_ordered_by_id(make_loans):
    day = [
        {"loan_id": 12, "risk_tier": "High", "channel": "Agent"},
        {"loan_id": 11, "risk_tier": "Low", "channel": "Branch"},
        {"loan_id": 13, "risk_tier": "Medium", "channel": "Online"},
    ]
    loans = make_loans(*day)
    assert c.risk_migration(loans).first()["risk_migration_pattern"] == "Deteriorated - Low to Medium"
    assert c.channel_acquisition(loans, TODAY).first()["acquisition_channel"] == "Branch"


def test_no_repeat_customers_means_no_migration(make_loans):
    assert c.risk_migration(make_loans({})).collect() == []


def test_affinity(make_loans):
    rows = c.product_affinity(
        make_loans(
            *loans_of(1, {"product_type": "SME"}, {"product_type": "POS"}, {"product_type": "SME"}),
            *loans_of(2, {"product_type": "POS"}, {"product_type": "SME"}),
            *loans_of(3, {"product_type": None}),
        ),
    ).collect()
    assert [(r["product_combination"], r["number_of_products"], r["customer_count"]) for r in rows] == [
        ("POS, SME", 2, 2),
        (None, 0, 1),
    ]


@pytest.mark.parametrize("width", [65, 500])
def test_affinity_of_many_products(make_loans, width):
    names = [f"product {i:03}" for i in range(width)]
    loans = make_loans(
        *loans_of(1, *({"product_type": p} for p in reversed(names))),
        *loans_of(2, {"product_type": names[-1]}, {"product_type": names[-1]}),
    )
    rows = c.product_affinity(loans).collect()
    assert [(r["product_combination"], r["number_of_products"]) for r in rows] == [
        (", ".join(names), width),
        (names[-1], 1),
    ]
    assert [r["total_loans"] for r in rows] == [width, 2]


def test_cohorts_count_loan_ids(make_loans):
    loans = make_loans(*loans_of(1, {}, {"loan_id": None, "days_past_due": 40}), *loans_of(2, {}, {}))
    row = c.acquisition_cohorts(loans, TODAY).first()
    assert (row["total_loans"], row["avg_loans_per_customer"]) == (3, 1.5)
    assert (row["par_30_rate_pct"], row["repeat_customer_pct"]) == (33.33, 50.0)


def test_channels(make_loans):
    rows = by(
        "acquisition_channel",
        c.channel_acquisition(
            make_loans(
                *loans_of(1, {"channel": "Agent", "origination_date": "2024-02-01"}, {"channel": "Branch"}),
                *loans_of(2, {"channel": "Branch"}),
                *loans_of(3, {"channel": None}, {"channel": "Agent", "origination_date": "2024-02-01"}),
            ),
            TODAY,
        ),
    )
    assert rows["Branch"]["customers_acquired"] == 2
    assert (rows["Branch"]["multi_channel_customers"], rows["Branch"]["multi_channel_pct"]) == (1, 50.0)
    assert rows["Branch"]["avg_customer_age_days"] == 60.0
    assert rows[None]["multi_channel_customers"] == 0


def test_warning_flags_texts_and_categories(make_loans):
    # customer n raises the first n flags of the list below; 6 raises only the last.
    late = {"days_past_due": 62}
    rows = by(
        "customer_id",
        c.early_warning(
            make_loans(
                *loans_of(1, {}, {"risk_score": 701}),
                *loans_of(2, {"days_past_due": 31}, {}, {"risk_score": 701}),
                *loans_of(3, late, {"actual_loss": 1}),
                *loans_of(4, {**late, "actual_loss": 1, "risk_score": 701}, {}),
                *loans_of(5, {**late, "actual_loss": 1, "risk_score": 701}),
                *loans_of(6, {"days_past_due": 1}),
                *loans_of(7, {"days_past_due": 30, "risk_score": 700}, {}),
            ),
            TODAY,
        ),
    )
    assert {k: (v["total_risk_flags"], v["risk_indicators"]) for k, v in rows.items()} == {
        1: (1, "High Risk Score, "),
        2: (2, "PAR 30+, High Risk Score, "),
        3: (3, "High DPD, PAR 30+, Has Loss, "),
        4: (4, "High DPD, PAR 30+, Has Loss, High Risk Score, "),
        5: (5, "High DPD, PAR 30+, Has Loss, High Risk Score, Frequent Arrears"),
        6: (1, "Frequent Arrears"),
    }
    assert [rows[i]["risk_category"].split(" - ")[0] for i in (1, 2, 3, 4, 5)] == [
        "Low Risk",
        "Medium Risk",
        "High Risk",
        "Critical",
        "Critical",
    ]
    assert rows[1]["days_since_last_loan"] == 60


def test_warning_order_and_cut(make_loans):
    loans = make_loans(
        *loans_of(1, {"days_past_due": 1}),
        *loans_of(2, {"days_past_due": 1, "loan_amount": 5000}),
        *loans_of(3, {"days_past_due": 40}),
        *loans_of(4, {"days_past_due": 1, "loan_amount": 5000}),
    )
    rows = c.early_warning(loans, TODAY).collect()
    assert [r["customer_id"] for r in rows] == [3, 2, 4, 1]
    assert c.early_warning(loans, TODAY, n=2).collect() == rows[:2]


def test_matrix_splits_at_the_median_with_ties_high(make_loans):
    rows = []
    for customer, (amount, score) in enumerate([(100, 500), (200, 600), (200, 600), (300, 700)], 1):
        rows += loans_of(customer, {"loan_amount": amount, "risk_score": score})
    rows += loans_of(5, {"loan_amount": 50, "risk_score": 500, "days_past_due": 16})
    got = by("customer_quadrant", c.profitability_matrix(make_loans(*rows)))
    assert {k: (v["customer_count"], v["strategic_action"]) for k, v in got.items()} == {
        "High Value / High Risk": (3, "MANAGE - Monitor & Protect"),
        "Low Value / Low Risk": (1, "DEVELOP - Upsell & Cross-sell"),
        "Low Value / High Risk": (1, "DIVEST - Minimize Exposure"),
    }


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [1.0, 2.0],
        [4.0, 1.0, 3.0, 2.0],
        [5.0, 5.0, 5.0, 1.0],
        [-1e12, -3.5, 0.0, 0.00001, 1e15, 7.0, 7.0000001],
        [None, 2.0, None, 8.0],
        [0.0] * 5 + [1e9] * 5,
    ],
)
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v, None if v is None else -v) for v in values], "a double, b double")
    got = exact_medians(df, "a", "b").first()
    want = df.agg(F.percentile("a", F.lit(0.5)).alias("a"), F.percentile("b", F.lit(0.5)).alias("b")).first()
    assert got == want


def test_exact_median_of_many(spark):
    df = spark.range(20_001).select((F.pow(F.rand(7), 9) * 1e8 - 50).alias("a"))
    assert exact_medians(df, "a").first() == df.agg(F.percentile("a", F.lit(0.5)).alias("a")).first()


@pytest.mark.parametrize(
    "expression",
    ["1000000 + pmod(id * 7919, 10000) / 100", "-id", "exp(id / 40.0)", "5.0", "if(id % 2 = 0, 1e-300, 1e300) * id"],
)
def test_exact_median_of_any_shape(spark, expression):
    df = spark.range(20_001).selectExpr(f"cast({expression} as double) as a")
    assert exact_medians(df, "a").first() == df.agg(F.percentile("a", F.lit(0.5)).alias("a")).first()


@pytest.mark.parametrize("accuracy", [10, 100, 1_000])
def test_exact_median_from_a_coarse_sketch(spark, accuracy):
    df = spark.range(30_001).repartition(7).selectExpr(
        "cast(pmod(id * 7919, 20011) as double) as a", "cast(if(id % 3 = 0, 5, id) as double) as b"
    )
    got = exact_medians(df, "a", "b", accuracy=accuracy).first()
    assert got == df.agg(F.percentile("a", F.lit(0.5)).alias("a"), F.percentile("b", F.lit(0.5)).alias("b")).first()


def test_few_values_lie_inside_the_bracket(spark):
    df = spark.range(100_000).repartition(5).selectExpr("cast(id as double) as a")
    bracket = df.withColumn("b", brackets(df, "a", accuracy=1_000))
    kept = bracket.where(inside(F.col("a"), F.col("b.a")).isNotNull())
    assert 0 < kept.count() <= 100_000 * 8 / 1_000


def test_products_beyond_the_coded_ones(make_loans):
    rows = [{"customer_id": k % 7, "product_type": f"p{k % 40:02}" if k % 9 else None, "channel": f"c{k % 5}"} for k in range(300)]
    loans = make_loans(*rows)
    by_bits, by_text = c.product_affinity(loans), c.product_affinity(loans, most_names=3)
    assert by_bits.collect() == by_text.collect()
    assert c.product_affinity(loans, most_names=40).collect() == by_text.collect()
    assert c.channel_acquisition(loans, TODAY).collect() == c.channel_acquisition(loans, TODAY, most_names=2).collect()


def test_sets_of_two_longs(make_loans):
    rows = [{"customer_id": k % 3, "product_type": f"p{k:03}"} for k in range(100)]
    got = by("number_of_products", c.product_affinity(make_loans(*rows)))
    assert got[34]["product_combination"] == ", ".join(f"p{k:03}" for k in range(0, 100, 3))
    assert got[34]["customer_count"] == 1 and set(got) == {33, 34}


def test_names_that_come_later_end_the_query(make_loans):
    names = cat.coded(make_loans({"product_type": "SME"}), "product_type")
    later = make_loans({"product_type": "SME"}, {"product_type": "New"})
    with pytest.raises(Exception, match="a name that was not there before: New"):
        later.groupBy("customer_id").agg(*(x.alias(n) for n, x in names.masks().items())).collect()
    nothing = make_loans({"product_type": None})
    assert c.product_affinity(nothing).first()["number_of_products"] == 0


def test_first_channel_of_equal_places(make_loans):
    loans = make_loans(
        {"loan_id": 1, "channel": "Online"}, {"loan_id": 1, "channel": "Agent"}, {"loan_id": 2, "channel": None},
        {"loan_id": 0, "customer_id": 2, "channel": None}, {"loan_id": 5, "customer_id": 2, "channel": "Agent"},
        {"loan_id": -4, "customer_id": 3, "channel": "Agent"}, {"loan_id": -5, "customer_id": 3, "channel": "Online"},
    )
    got = {r["acquisition_channel"]: r["customers_acquired"] for r in c.channel_acquisition(loans, TODAY).collect()}
    assert got == {"Agent": 1, None: 1, "Online": 1}


def test_thresholds(make_loans):
    loans = make_loans(*loans_of(1, {"days_past_due": 20, "risk_score": 690}))
    assert c.early_warning(loans, TODAY, arrears_share=1.0).count() == 0
    row = c.early_warning(loans, TODAY, mean_dpd=10, risk_score=600, arrears_share=1.0).first()
    assert row["total_risk_flags"] == 2
    assert c.customer_clv(loans).first()["clv_tier"] == "Bronze"
    assert c.customer_clv(loans, tiers=((10, "Top"),)).first()["clv_tier"] == "Top"


def test_median_of_nothing(spark):
    assert exact_medians(spark.createDataFrame([], "a double"), "a").first()["a"] is None


def test_cohorts(make_loans):
    rows = c.acquisition_cohorts(
        make_loans(
            *loans_of(1, {"origination_date": "2024-01-31"}, {"origination_date": "2024-02-05", "days_past_due": 31}),
            *loans_of(2, {"origination_date": "2024-01-01"}),
            *loans_of(3, {"origination_date": "2023-11-30"}),
            {"customer_id": None, "origination_date": "2020-01-01"},
        ),
        TODAY,
    ).collect()
    assert [(r["cohort_month"], r["customers_acquired"], r["total_loans"]) for r in rows] == [
        ("2023-11", 1, 1),
        ("2024-01", 2, 3),
    ]
    january = rows[1]
    assert (january["repeat_customer_pct"], january["par_30_rate_pct"]) == (50.0, 33.33)
    assert january["avg_cohort_age_days"] == 45.0


def test_health_score_adjustments(make_loans):
    loans = make_loans(
        *loans_of(1, {}),
        *loans_of(2, {"days_past_due": 20}),
        *loans_of(3, {"days_past_due": 40}),
        *loans_of(4, {"actual_loss": 1}),
        *loans_of(5, {}, {}, {}),
        *loans_of(6, {"product_type": "POS"}, {}),
        *loans_of(7, {"product_type": "POS"}, {}, {}),
        *loans_of(8, *[{"days_past_due": 120, "actual_loss": 1}] * 9),
    )
    rows = by("customer_id", c.top_customers(loans, TODAY))
    assert {k: v["customer_health_score"] for k, v in rows.items()} == {
        1: 100.0,
        2: 90.0,
        3: 70.0,
        4: 80.0,
        5: 110.0,
        6: 105.0,
        7: 115.0,
        8: -60.0,
    }


def test_top_customer_profile(make_loans):
    loans = make_loans(
        *loans_of(
            1,
            {"product_type": "SME", "channel": "Online", "risk_tier": "Low", "status": "Closed", "risk_score": 600},
            {"product_type": "POS", "channel": "Agent", "risk_tier": "High", "origination_date": "2024-01-31"},
        ),
        *loans_of(2, {"loan_amount": 1}),
    )
    rows = c.top_customers(loans, TODAY).collect()
    assert [r["customer_id"] for r in rows] == [1, 2]
    row = rows[0].asDict()
    assert (row["product_mix"], row["channel_mix"]) == ("POS, SME", "Agent, Online")
    assert (row["risk_tiers"], row["loan_statuses"]) == ("High, Low", "Active, Closed")
    assert (row["customer_tenure_days"], row["relationship_duration_days"]) == (60, 30)
    assert (row["min_risk_score"], row["max_risk_score"], row["avg_risk_score"]) == (600, 650, 625.0)
    assert c.top_customers(loans, TODAY, n=1).collect() == rows[:1]


def test_age_counts_to_today_by_default(spark, make_loans):
    row = make_loans({}).select(
        m.days_since(F.col("origination_date"), None).alias("age"),
        F.datediff(F.current_date(), F.col("origination_date")).alias("want"),
    ).first()
    assert row["age"] == row["want"]


def test_coded_first_channel_equals_the_least_struct(make_loans):
    loans = make_loans(
        *[
            {"customer_id": 1, "loan_id": i, "channel": channel, "origination_date": day}
            for i, channel, day in [(3, "B", "2024-01-01"), (-5, "A", "2024-01-01"), (2**62, "C", "2023-01-01")]
        ],
        {"customer_id": 2, "loan_id": 9, "channel": "A", "origination_date": "0001-01-01"},
        {"customer_id": 2, "loan_id": 10, "channel": "C", "origination_date": None},
        {"customer_id": 3, "loan_id": -(2**62), "channel": "C", "origination_date": "9999-12-31"},
        {"customer_id": 3, "loan_id": -(2**62) - 1, "channel": "B", "origination_date": "9999-12-31"},
    )
    plain = {k: v["first_channel"] for k, v in by("customer_id", customer_metrics(loans, "first_channel")).items()}
    assert plain == {1: "C", 2: "C", 3: "B"}
    coded = by("acquisition_channel", c.channel_acquisition(loans, TODAY))
    assert {k: v["customers_acquired"] for k, v in coded.items()} == {"C": 2, "B": 1}
