"""DuckDB SQL that computes each query of the catalog a second way.

The Spark side shares no text with it. Windows stand where Spark uses structs or slices,
and built-in medians where Spark uses bins, so that agreement means something.
"""

from __future__ import annotations

LOANS = """
keyed as (
  select o_orderkey as loan_id, o_custkey*4 + o_orderkey%4 as customer_id,
         cast(o_totalprice as decimal(18,2)) as loan_amount,
         cast(cast(1000 + (o_orderkey*37)%2100 as decimal(10,0))*0.01 as decimal(5,2)) as interest_rate,
         cast(6*(1+o_orderkey%7) as int) as tenure_months,
         cast(550+(o_orderkey*7919+o_custkey*31)%251 as int) as risk_score,
         (o_orderkey*104729+o_custkey*1299709)%997 as h,
         cast(o_orderdate as date) as origination_date,
         o_orderpriority, o_orderstatus
  from orders
),
late as (
  select *, cast(case when h<508 then 0 when h<868 then 1+h%30 when h<928 then 31+h%30
                      when h<968 then 61+h%30 else 91+h%30 end as int) as days_past_due
  from keyed
),
loans as (
  select loan_id, customer_id, loan_amount, interest_rate, tenure_months, risk_score,
         days_past_due, origination_date,
         case o_orderpriority when '1-URGENT' then 'Personal' when '2-HIGH' then 'SME'
              when '3-MEDIUM' then 'Salary' else 'POS' end as product_type,
         case loan_id%3 when 0 then 'Agent' when 1 then 'Branch' else 'Online' end as channel,
         case when risk_score<640 then 'Low' when risk_score<715 then 'Medium' else 'High' end as risk_tier,
         case when days_past_due=0 then 'Current' when days_past_due<=30 then 'PAR 1-30'
              when days_past_due<=60 then 'PAR 31-60' when days_past_due<=90 then 'PAR 61-90'
              else 'PAR 90+' end as par_bucket,
         case when o_orderstatus='F' then 'Closed' when o_orderstatus='O' then 'Active'
              when days_past_due>90 then 'Written Off' when days_past_due>60 then 'Defaulted'
              else 'In Collection' end as status,
         cast(loan_amount*(case when risk_score<640 then 0.002 when risk_score<715 then 0.006
                                else 0.012 end) as decimal(18,2)) as expected_loss,
         cast(case when days_past_due>60 then loan_amount*0.100 else 0 end as decimal(18,2)) as actual_loss
  from late
)"""


def _round(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(38,10)), {digits}) as double)"


def _ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def _pct(a: str, b: str) -> str:
    return _round(f"{_ratio(a, b)} * 100", 2)


def _mean(col: str) -> str:
    return _ratio(f"sum({col})", f"count({col})")


def _dbl(x: str) -> str:
    return f"cast({x} as double)"


def _int(x: str) -> str:
    return f"cast({x} as bigint)"


INCOME = "sum(loan_amount * interest_rate) * 0.01"
PROFIT = f"({INCOME} - sum(actual_loss))"
LATE = "count(*) filter (where days_past_due > 30)"
LATE_AMOUNT = "coalesce(sum(loan_amount) filter (where days_past_due > 30), 0)"
PAR_RATE = _pct(LATE_AMOUNT, "sum(loan_amount)")
LOSS_RATE = _pct("sum(actual_loss)", "sum(loan_amount)")
NET_RETURN = _pct(PROFIT, "sum(loan_amount)")
BAND = """case when risk_score < 600 then '< 600' when risk_score < 650 then '600-649'
     when risk_score < 700 then '650-699' when risk_score < 750 then '700-749' else '750+' end"""
HIGH_RISK = "(risk_tier = 'High' or days_past_due > 60 or actual_loss > 0)"
DELINQUENCY = """case when days_past_due > 90 then 1 when days_past_due > 60 then 2
     when days_past_due > 30 then 3 else 4 end"""
AS_OF = "date '2026-04-23'"


def _mix(col: str) -> str:
    return f"string_agg(distinct {col}, ', ' order by {col})"


CUSTOMERS = f"""
customers as (
  select customer_id,
         count(*) as n, count(loan_id) as n_ids,
         sum(loan_amount) as borrowed,
         {_mean("loan_amount")} as mean_amount,
         min(loan_amount) as min_amount, max(loan_amount) as max_amount,
         {_mean("interest_rate")} as mean_rate,
         {INCOME} as income,
         sum(actual_loss) as lost,
         {PROFIT} as profit,
         {_mean("risk_score")} as mean_score,
         min(risk_score) as min_score, max(risk_score) as max_score,
         {_mean("days_past_due")} as mean_dpd,
         max(days_past_due) as max_dpd,
         count(*) filter (where days_past_due > 0) as in_arrears,
         {LATE} as late,
         min(origination_date) as first_day, max(origination_date) as last_day,
         count(distinct product_type) as n_products, {_mix("product_type")} as products,
         count(distinct channel) as n_channels, {_mix("channel")} as channels,
         {_mix("risk_tier")} as tiers, {_mix("status")} as statuses
  from loans group by customer_id
)"""

SEQUENCE = """
sequence as (
  select *,
         row_number() over own as loan_number,
         lag(origination_date) over own as previous_loan_date,
         lag(loan_amount) over own as previous_loan_amount,
         lag(days_past_due) over own as previous_loan_dpd
  from loans
  window own as (partition by customer_id order by origination_date nulls first, loan_id nulls first)
)"""

ENDPOINTS = """
endpoints as (
  select customer_id, risk_tier, risk_score, channel,
         row_number() over (partition by customer_id order by origination_date, loan_id) as from_first,
         row_number() over (partition by customer_id order by origination_date desc, loan_id desc) as from_last,
         count(*) over (partition by customer_id) as n
  from loans
)"""

GROWTH = _pct("loan_amount - previous_loan_amount", "previous_loan_amount")

FLAGS = """
flagged as (
  select *,
         cast(mean_dpd > 30 as int) as flag_high_dpd,
         cast(late > 0 as int) as flag_par_30,
         cast(lost > 0 as int) as flag_has_loss,
         cast(max_score > 700 as int) as flag_high_risk_score,
         cast(in_arrears / n > 0.5 as int) as flag_frequent_arrears
  from customers
),
warned as (
  select *, cast(flag_high_dpd + flag_par_30 + flag_has_loss + flag_high_risk_score
                 + flag_frequent_arrears as bigint) as flags,
         if(flag_high_dpd = 1, 'High DPD, ', '') || if(flag_par_30 = 1, 'PAR 30+, ', '')
         || if(flag_has_loss = 1, 'Has Loss, ', '') || if(flag_high_risk_score = 1, 'High Risk Score, ', '')
         || if(flag_frequent_arrears = 1, 'Frequent Arrears', '') as indicators
  from flagged
)"""

HEALTH = _round(
    "100 - greatest(mean_dpd, 0) * 0.5 - 10 * late - if(lost > 0, 20, 0)"
    " + if(n > 2, 10, 0) + if(n_products > 1, 5, 0)",
    0,
)


def _over_loans(select: str) -> str:
    return f"with {LOANS}\n{select}"


def _over_customers(select: str) -> str:
    return f"with {LOANS},{CUSTOMERS}\n{select}"


def _over(ctes: list[str], select: str) -> str:
    return f"with {','.join([LOANS, *ctes])}\n{select}"


def _grouped(keys: str, aggregates: str, order: str = "") -> str:
    tail = f" order by {order}" if order else ""
    return _over_loans(f"select {keys}, {aggregates} from loans group by all{tail}")


def _overview() -> str:
    def par(days: int) -> str:
        return f"days_past_due > {days}"

    bad = "status in ('Defaulted', 'Written Off')"
    n, value = "count(distinct loan_id)", "sum(loan_amount)"

    def count(where: str) -> str:
        return f"count(*) filter (where {where})"

    def amount(where: str) -> str:
        return f"coalesce(sum(loan_amount) filter (where {where}), 0)"

    columns = {
        "total_loans": n,
        "total_customers": "count(distinct customer_id)",
        "total_portfolio_value": _dbl(value),
        "avg_loan_size": _mean("loan_amount"),
        "avg_interest_rate_pct": _round(_mean("interest_rate"), 2),
        "avg_risk_score": _round(_mean("risk_score"), 0),
        "avg_tenure_months": _round(_mean("tenure_months"), 1),
        "loans_in_arrears": count(par(0)),
        "loans_par_30": count(par(30)),
        "loans_par_60": count(par(60)),
        "loans_par_90": count(par(90)),
        "defaulted_loans": count("status = 'Defaulted'"),
        "amount_in_arrears": _dbl(amount(par(0))),
        "amount_par_30": _dbl(amount(par(30))),
        "amount_par_60": _dbl(amount(par(60))),
        "amount_par_90": _dbl(amount(par(90))),
        "defaulted_amount": _dbl(amount("status = 'Defaulted'")),
        "arrears_rate_pct": _pct(count(par(0)), n),
        "par_rate_pct": _pct(amount(par(0)), value),
        "par_30_rate_pct": _pct(amount(par(30)), value),
        "par_90_rate_pct": _pct(amount(par(90)), value),
        "default_rate_pct": _pct(count("status = 'Defaulted'"), n),
        "default_amount_pct": _pct(amount("status = 'Defaulted'"), value),
        "total_expected_loss": _dbl("sum(expected_loss)"),
        "total_actual_loss": _dbl("sum(actual_loss)"),
        "expected_loss_rate_pct": _pct("sum(expected_loss)", value),
        "actual_loss_rate_pct": _pct("sum(actual_loss)", value),
        **{f"{t.lower()}_risk_loans": count(f"risk_tier = '{t}'") for t in ("High", "Medium", "Low")},
        **{f"{t.lower()}_risk_pct": _pct(count(f"risk_tier = '{t}'"), n) for t in ("High", "Medium", "Low")},
        "estimated_annual_interest_income": _dbl(INCOME),
        "active_portfolio_value": _dbl(amount("status = 'Active'")),
        "non_performing_value": _dbl(amount(bad)),
        "active_loans": count("status = 'Active'"),
        "closed_loans": count("status = 'Closed'"),
        "non_performing_loans": count(bad),
        "active_loan_pct": _pct(count("status = 'Active'"), n),
        "npl_ratio_pct": _pct(count(bad), n),
        "npl_amount_pct": _pct(amount(bad), value),
        "net_return_on_portfolio_pct": NET_RETURN,
    }
    return _over_loans("select " + ",\n  ".join(f"{x} as {a}" for a, x in columns.items()) + "\nfrom loans")


def _high_risk(limit: str) -> str:
    return _over_loans(
        f"""select loan_id, customer_id, product_type, channel, {_dbl("loan_amount")} as loan_amount,
  {_dbl("interest_rate")} as interest_rate, risk_score, risk_tier, days_past_due, par_bucket, status,
  origination_date, {_dbl("expected_loss")} as expected_loss, {_dbl("actual_loss")} as actual_loss,
  {_pct("actual_loss", "loan_amount")} as loss_rate_pct
from loans where {HIGH_RISK}
order by {DELINQUENCY}, loans.loan_amount desc, loan_id {limit}"""
    )


def _concentration(limit: str) -> str:
    return _over_loans(
        f"""select customer_id, count(*) as number_of_loans, {_dbl("sum(loan_amount)")} as total_exposure,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate, {_round(_mean("risk_score"), 0)} as avg_risk_score,
  max(risk_tier) as highest_risk_tier, {LATE} as loans_par_30_plus,
  {_round("sum(actual_loss)", 2)} as total_loss,
  {_pct("sum(loan_amount)", "(select sum(loan_amount) from loans)")} as pct_of_portfolio
from loans group by customer_id having count(*) > 1
order by sum(loan_amount) desc, customer_id {limit}"""
    )


def _clv(limit: str) -> str:
    clv = _round("profit", 2)
    return _over_customers(
        f"""select customer_id, n as total_loans, {_dbl("borrowed")} as total_borrowed,
  {_round("mean_rate", 2)} as avg_interest_rate, {_round("mean_score", 0)} as avg_risk_score,
  {_round("income", 2)} as total_interest_income, {_round("lost", 2)} as total_actual_loss,
  {clv} as customer_lifetime_value, {_pct(clv, "borrowed")} as clv_margin_pct,
  first_day as first_loan_date, last_day as last_loan_date,
  date_diff('day', first_day, last_day) as relationship_duration_days,
  mean_dpd as avg_days_past_due, late as delinquency_count, n_products as products_used,
  products as product_mix,
  case when {clv} > 50000 then 'Platinum' when {clv} > 30000 then 'Gold'
       when {clv} > 15000 then 'Silver' else 'Bronze' end as clv_tier
from customers order by customer_lifetime_value desc, customer_id {limit}"""
    )


def _warning(limit: str) -> str:
    return _over(
        [CUSTOMERS, FLAGS],
        f"""select customer_id, n as total_loans, {_dbl("borrowed")} as total_exposure,
  mean_score as avg_risk_score, max_score as max_risk_score, mean_dpd as avg_days_past_due,
  max_dpd as max_days_past_due, in_arrears as loans_with_arrears, late as loans_par_30,
  {_dbl("lost")} as total_loss, last_day as last_loan_date,
  date_diff('day', last_day, {AS_OF}) as days_since_last_loan, products, statuses as loan_statuses,
  flags as total_risk_flags,
  case when flags >= 4 then 'Critical - Immediate Action' when flags = 3 then 'High Risk - Urgent Attention'
       when flags = 2 then 'Medium Risk - Monitor Closely' when flags = 1 then 'Low Risk - Watch'
       else 'Healthy - No Action' end as risk_category,
  indicators as risk_indicators
from warned where flags > 0 order by flags desc, borrowed desc, customer_id {limit}""",
    )


def _profiles(limit: str) -> str:
    return _over_customers(
        f"""select customer_id, n as total_loans, first_day as first_loan_date, last_day as last_loan_date,
  date_diff('day', first_day, last_day) as relationship_duration_days,
  date_diff('day', first_day, {AS_OF}) as customer_tenure_days,
  {_dbl("borrowed")} as total_borrowed, {_round("mean_amount", 0)} as avg_loan_size,
  {_dbl("min_amount")} as min_loan_size, {_dbl("max_amount")} as max_loan_size,
  {_round("mean_rate", 2)} as avg_interest_rate, {_round("income", 2)} as total_revenue,
  {_round("lost", 2)} as total_actual_loss, {_round("profit", 2)} as customer_lifetime_value,
  {_pct("profit", "borrowed")} as clv_margin_pct, {_round("mean_score", 0)} as avg_risk_score,
  min_score as min_risk_score, max_score as max_risk_score, {_round("mean_dpd", 1)} as avg_days_past_due,
  max_dpd as max_days_past_due, in_arrears as loans_with_arrears, late as loans_par_30,
  n_products as unique_products, n_channels as unique_channels, products as product_mix,
  channels as channel_mix, tiers as risk_tiers, statuses as loan_statuses,
  {HEALTH} as customer_health_score
from customers order by customer_lifetime_value desc, customer_id {limit}"""
    )


def _roll_up(key: str, count_name: str, columns: dict[str, str], source: str) -> str:
    """Group a customer-grain relation by `key`."""
    listed = ",\n  ".join(f"{x} as {a}" for a, x in columns.items())
    return f"select {key},\n  count(*) as {count_name},\n  {listed}\nfrom {source} group by all"


SHARE = _pct("count(*)", "sum(count(*)) over ()")
CUSTOMER_VALUE = {
    "total_loans": _int("sum(n)"),
    "total_portfolio_value": _dbl("sum(borrowed)"),
    "avg_customer_value": _round(_mean("borrowed"), 0),
}
MARGIN = _pct("sum(income) - sum(lost)", "sum(borrowed)")
MEAN_DPD = _round("avg(mean_dpd)", 1)


def _segmentation() -> str:
    columns = {
        "pct_of_customers": SHARE,
        **CUSTOMER_VALUE,
        "avg_loan_size": _round("avg(mean_amount)", 0),
        "avg_risk_score": _round("avg(mean_score)", 0),
        "avg_tenure_days": _round(f"avg(date_diff('day', first_day, {AS_OF}))", 0),
        "total_interest_income": _round("sum(income)", 2),
        "total_loss": _round("sum(lost)", 2),
        "avg_profitability_pct": _round(f"avg({_pct('profit', 'borrowed')})", 2),
        "avg_days_past_due": MEAN_DPD,
    }
    segment = """case when n >= 3 and lost = 0 and mean_dpd = 0 then 'VIP - High Value'
     when n >= 2 and lost = 0 and mean_dpd < 15 then 'Premium - Good Standing'
     when n = 1 and lost = 0 and mean_dpd = 0 then 'New - Performing'
     when lost > 0 or mean_dpd > 60 then 'High Risk - Attention Needed'
     when mean_dpd > 30 then 'At Risk - Monitor' else 'Standard - Regular' end as customer_segment"""
    return _over_customers(_roll_up(segment, "customer_count", columns, "customers"))


def _affinity() -> str:
    columns = {
        "pct_of_customers": SHARE,
        **CUSTOMER_VALUE,
        "avg_interest_rate": _round("avg(mean_rate)", 2),
        "total_revenue": _round("sum(income)", 2),
        "total_loss": _round("sum(lost)", 2),
        "net_margin_pct": MARGIN,
        "avg_days_past_due": MEAN_DPD,
    }
    key = "products as product_combination, n_products as number_of_products"
    return _over_customers(_roll_up(key, "customer_count", columns, "customers"))


def _channels() -> str:
    multi = "count(*) filter (where n_channels > 1)"
    columns = {
        "pct_of_customers": SHARE,
        **CUSTOMER_VALUE,
        "avg_loans_per_customer": _round("avg(n)", 2),
        "avg_risk_score": _round("avg(mean_score)", 0),
        "total_revenue": _round("sum(income)", 2),
        "total_loss": _round("sum(lost)", 2),
        "net_margin_pct": MARGIN,
        "avg_days_past_due": MEAN_DPD,
        "avg_customer_age_days": _round(f"avg(date_diff('day', first_day, {AS_OF}))", 0),
        "multi_channel_customers": multi,
        "multi_channel_pct": _pct(multi, "count(*)"),
    }
    source = """(select c.*, e.channel as acquisition_channel from customers c
      join endpoints e on e.customer_id is not distinct from c.customer_id and e.from_first = 1)"""
    return _over([CUSTOMERS, ENDPOINTS], _roll_up("acquisition_channel", "customers_acquired", columns, source))


def _cohorts() -> str:
    columns = {
        **CUSTOMER_VALUE,
        "total_loans": _int("sum(n_ids)"),
        "avg_loans_per_customer": _round("avg(n_ids)", 2),
        "avg_risk_score": _round("avg(mean_score)", 0),
        "total_revenue": _round("sum(income)", 2),
        "total_loss": _round("sum(lost)", 2),
        "net_margin_pct": MARGIN,
        "avg_days_past_due": MEAN_DPD,
        "total_loans_par_30": _int("sum(late)"),
        "par_30_rate_pct": _pct("sum(late)", "sum(n_ids)"),
        "avg_cohort_age_days": _round(f"avg(date_diff('day', first_day, {AS_OF}))", 0),
        "repeat_customer_pct": _pct("count(*) filter (where n_ids > 1)", "count(*)"),
    }
    key = "strftime(first_day, '%Y-%m') as cohort_month"
    source = "(from customers where customer_id is not null)"
    return _over_customers(_roll_up(key, "customers_acquired", columns, source))


MEDIANS = """
middle as (
  select quantile_cont(cast(profit as double), 0.5) as profit_mid,
         quantile_cont(mean_score, 0.5) as score_mid
  from customers
)"""


def _matrix() -> str:
    columns = {
        "pct_of_customers": SHARE,
        **CUSTOMER_VALUE,
        "avg_risk_score": _round("avg(mean_score)", 0),
        "total_revenue": _round("sum(income)", 2),
        "total_loss": _round("sum(lost)", 2),
        "total_net_profit": _round("sum(profit)", 2),
        "avg_profit_per_customer": _round(_mean("profit"), 0),
        "avg_days_past_due": MEAN_DPD,
        "strategic_action": """case worth || risk
    when 'HighLow' then 'GROW - Invest & Expand' when 'HighHigh' then 'MANAGE - Monitor & Protect'
    when 'LowLow' then 'DEVELOP - Upsell & Cross-sell' when 'LowHigh' then 'DIVEST - Minimize Exposure' end""",
    }
    source = """(select customers.*, if(cast(profit as double) >= profit_mid, 'High', 'Low') as worth,
             if(mean_score >= score_mid or mean_dpd > 15, 'High', 'Low') as risk
      from customers, middle)"""
    key = "worth || ' Value / ' || risk || ' Risk' as customer_quadrant"
    listed = _roll_up(key, "customer_count", columns, source)
    return _over([CUSTOMERS, MEDIANS], listed.replace("group by all", "group by worth, risk"))


def _retention() -> str:
    customers = "count(distinct customer_id)"
    return _over(
        [SEQUENCE],
        f"""select loan_number as customer_loan_sequence, {customers} as customer_count,
  {_round(_mean("loan_amount"), 0)} as avg_loan_amount,
  {_round("avg(date_diff('day', previous_loan_date, origination_date))", 0)} as avg_days_between_loans,
  {_round(f"avg({GROWTH})", 2)} as avg_loan_growth_pct,
  {_round(_mean("risk_score"), 0)} as avg_risk_score, {_round(_mean("days_past_due"), 1)} as avg_days_past_due,
  {LATE} as loans_par_30, {_pct(LATE, "count(*)")} as par_30_rate_pct,
  {_round("sum(actual_loss)", 2)} as total_loss,
  {_pct(customers, f"lag({customers}) over (order by loan_number)")} as retention_rate_pct
from sequence group by loan_number order by loan_number""",
    )


def _migration() -> str:
    return _over(
        [ENDPOINTS],
        f"""select risk_migration_pattern, count(*) as customer_count, {SHARE} as pct_of_repeat_customers,
  {_round("avg(latest_score - first_score)", 0)} as avg_risk_score_change,
  {_round("avg(first_score)", 0)} as avg_initial_risk_score,
  {_round("avg(latest_score)", 0)} as avg_latest_risk_score
from (
  select a.risk_score as first_score, z.risk_score as latest_score,
         case when a.risk_tier = z.risk_tier then 'Stable - No Change'
              when list_position(['Low', 'Medium', 'High'], a.risk_tier)
                   > list_position(['Low', 'Medium', 'High'], z.risk_tier)
              then 'Improved - ' || a.risk_tier || ' to ' || z.risk_tier
              else 'Deteriorated - ' || a.risk_tier || ' to ' || z.risk_tier end as risk_migration_pattern
  from endpoints a join endpoints z using (customer_id)
  where a.from_first = 1 and z.from_last = 1 and a.n > 1
) group by risk_migration_pattern""",
    )


HEADLINE = {
    "portfolio_overview": _overview(),
    "par_bucket_distribution": _grouped(
        "par_bucket",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as total_amount,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate, {_round("sum(actual_loss)", 2)} as total_loss""",
        "min(days_past_due)",
    ),
    "risk_tier_profitability": _grouped(
        "risk_tier",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate, {_round(INCOME, 2)} as estimated_interest_income,
  {_round("sum(actual_loss)", 2)} as total_actual_loss, {NET_RETURN} as net_return_pct""",
        "min(risk_score)",
    ),
    "product_performance": _grouped(
        "product_type",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate, {LATE} as loans_par_30_plus,
  {PAR_RATE} as par_30_rate_pct, {LOSS_RATE} as loss_rate_pct, {NET_RETURN} as net_return_pct""",
        "portfolio_value desc, product_type",
    ),
    "monthly_origination_trend": _grouped(
        "strftime(origination_date, '%Y-%m') as origination_month",
        f"""count(*) as loans_originated, {_dbl("sum(loan_amount)")} as amount_originated,
  {_round(_mean("risk_score"), 0)} as avg_risk_score, {PAR_RATE} as par_30_rate_pct""",
        "origination_month",
    ),
    "channel_performance": _grouped(
        "channel",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_round(_mean("loan_amount"), 0)} as avg_loan_size, {_round(_mean("interest_rate"), 2)} as avg_interest_rate,
  count(*) filter (where risk_tier = 'Low') as low_risk_count,
  count(*) filter (where risk_tier = 'Medium') as medium_risk_count,
  count(*) filter (where risk_tier = 'High') as high_risk_count,
  {PAR_RATE} as par_30_rate_pct, {LOSS_RATE} as loss_rate_pct, {NET_RETURN} as net_return_pct""",
        "portfolio_value desc, channel",
    ),
    "loan_status_breakdown": _grouped(
        "status",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as total_amount,
  {_round(_mean("loan_amount"), 0)} as avg_loan_size, {_round(_mean("days_past_due"), 0)} as avg_days_past_due,
  {_round("sum(actual_loss)", 2)} as total_actual_loss,
  {SHARE} as pct_of_total_loans,
  {_pct("sum(loan_amount)", "sum(sum(loan_amount)) over ()")} as pct_of_total_amount""",
        "loan_count desc, status",
    ),
    "high_risk_loans": _high_risk("limit 20"),
    "portfolio_concentration": _concentration("limit 20"),
    "risk_score_validation": _grouped(
        f"{BAND} as risk_score_band",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate, {PAR_RATE} as par_30_rate_pct,
  {LOSS_RATE} as actual_loss_rate_pct,
  {_pct("sum(expected_loss)", "sum(loan_amount)")} as expected_loss_rate_pct,
  {_pct("sum(actual_loss) - sum(expected_loss)", "sum(expected_loss)")} as loss_variance_pct""",
        "min(risk_score)",
    ),
    "customer_segmentation": _segmentation(),
    "customer_clv": _clv("limit 50"),
    "customer_retention": _retention(),
    "risk_migration": _migration(),
    "product_affinity": _affinity(),
    "channel_acquisition": _channels(),
    "early_warning": _warning("limit 100"),
    "profitability_matrix": _matrix(),
    "acquisition_cohorts": _cohorts(),
    "top_customers": _profiles("limit 30"),
}

UNCUT = {
    "high_risk_loans_all": _high_risk(""),
    "portfolio_concentration_all": _concentration(""),
    "customer_clv_all": _clv(""),
    "early_warning_all": _warning(""),
    "top_customers_all": _profiles(""),
}

YEARLY = "loan_amount * interest_rate * 0.01"

PRIMITIVES = {
    "op_scan": _over_loans(
        f"""select * replace ({_dbl("loan_amount")} as loan_amount, {_dbl("interest_rate")} as interest_rate,
  {_dbl("expected_loss")} as expected_loss, {_dbl("actual_loss")} as actual_loss) from loans"""
    ),
    "op_project": _over_loans(
        f"select loan_id, customer_id as borrower_id, {_dbl(YEARLY)} as yearly_interest from loans"
    ),
    "op_ratio": _grouped(
        "tenure_months",
        f"{PAR_RATE} as par_30_rate_pct, {LOSS_RATE} as loss_rate_pct, {NET_RETURN} as net_return_pct",
    ),
    "op_round": _over_loans(
        f"""select loan_id, {_round(YEARLY, 0)} as interest_0, {_round(YEARLY, 1)} as interest_1,
  {_round(YEARLY, 2)} as interest_2 from loans"""
    ),
    "op_concat": _over_loans("select loan_id, product_type || ' / ' || channel as line from loans"),
    "op_month": _over_loans(
        "select loan_id, strftime(origination_date, '%Y-%m') as origination_month from loans"
    ),
    "op_date_diff": _grouped(
        "customer_id",
        "date_diff('day', min(origination_date), max(origination_date)) as relationship_days",
    ),
    "op_age_days": _grouped(
        "customer_id", f"date_diff('day', max(origination_date), {AS_OF}) as days_since_last_loan"
    ),
    "op_nullif": _over_loans(
        f"""select loan_id, {_pct("actual_loss", "loan_amount")} as loss_rate_pct,
  {_round(_ratio("expected_loss", "actual_loss"), 2)} as expected_per_actual from loans"""
    ),
    "op_filter_or": _over_loans(
        f"""select loan_id, risk_tier, days_past_due, {_dbl("actual_loss")} as actual_loss
from loans where {HIGH_RISK}"""
    ),
    "op_in_list": _over_loans("select loan_id, status from loans where status in ('Defaulted', 'Written Off')"),
    "op_filter_window": _over_loans(
        """select customer_id, loan_id,
  row_number() over (partition by customer_id order by origination_date, loan_id) as loan_number
from loans qualify loan_number > 1"""
    ),
    "op_filter_flags": _over(
        [CUSTOMERS, FLAGS], "select customer_id, flags as total_risk_flags from warned where flags > 0"
    ),
    "op_having": _over_loans(
        "select customer_id, count(*) as number_of_loans from loans group by customer_id having count(*) > 1"
    ),
    "op_case_band": _over_loans(f"select loan_id, {BAND} as risk_score_band from loans"),
    "op_case_no_else": _over_loans(
        """select loan_id,
  case when loan_amount >= 250000 and risk_tier = 'Low' then 'GROW - Invest & Expand'
       when loan_amount >= 250000 and risk_tier = 'High' then 'MANAGE - Monitor & Protect'
       when loan_amount < 250000 and risk_tier = 'Low' then 'DEVELOP - Upsell & Cross-sell'
       when loan_amount < 250000 and risk_tier = 'High' then 'DIVEST - Minimize Exposure'
  end as strategic_action
from loans"""
    ),
    "op_flags": _over(
        [CUSTOMERS, FLAGS],
        """select customer_id, flag_high_dpd, flag_par_30, flag_has_loss, flag_high_risk_score,
  flag_frequent_arrears from flagged""",
    ),
    "op_risk_indicators": _over(
        [CUSTOMERS, FLAGS], "select customer_id, indicators as risk_indicators from warned"
    ),
    "op_health_score": _over_customers(f"select customer_id, {HEALTH} as customer_health_score from customers"),
    "op_null_guard": _over(
        [SEQUENCE],
        f"""select customer_id, loan_id,
  case when previous_loan_amount is not null then {GROWTH} end as loan_size_growth_pct from sequence""",
    ),
    "op_equi_join": _over_loans(
        """select loan_id, customer_id, first_loan_date,
  date_diff('day', first_loan_date, origination_date) as days_since_first_loan
from loans join (select customer_id, min(origination_date) as first_loan_date from loans group by all)
  using (customer_id)"""
    ),
    "op_cross_join": _over_loans(
        f"""select total_loans, loans_par_30, {_pct("loans_par_30", "total_loans")} as par_30_share_pct
from (select count(*) as total_loans from loans) cross join (select {LATE} as loans_par_30 from loans)"""
    ),
    "op_scalar_subquery": _grouped(
        "customer_id",
        f"""{_pct("sum(loan_amount)", "(select sum(loan_amount) from loans)")} as pct_of_portfolio""",
    ),
    "op_global_agg": _over_loans(
        f"""select count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_mean("loan_amount")} as avg_loan_size from loans"""
    ),
    "op_group_agg": _grouped(
        "product_type",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate""",
    ),
    "op_group_multi": _grouped(
        "product_type, channel, risk_tier",
        f"""count(*) as loan_count, {_round("sum(actual_loss)", 2)} as total_loss""",
    ),
    "op_group_alias": _grouped(
        "strftime(origination_date, '%Y-%m') as origination_month", "count(*) as loans_originated"
    ),
    "op_count_col": _grouped(
        "channel", "count(loan_id) as loan_count, count(nullif(actual_loss, 0)) as loans_with_loss"
    ),
    "op_count_distinct": _grouped("product_type", "count(distinct customer_id) as customers"),
    "op_count_if": _grouped(
        "channel",
        ", ".join(f"count_if(days_past_due > {d})::bigint as loans_par_{d}" for d in (0, 30, 60, 90)),
    ),
    "op_conditional_sum": _grouped(
        "channel",
        ", ".join(
            f"cast(sum(case when days_past_due > {d} then loan_amount else 0 end) as double) as amount_par_{d}"
            for d in (0, 30, 60, 90)
        ),
    ),
    "op_min_max": _grouped(
        "product_type",
        f"""min(origination_date) as first_loan_date, max(origination_date) as last_loan_date,
  {_dbl("min(loan_amount)")} as min_loan_size, {_dbl("max(loan_amount)")} as max_loan_size""",
    ),
    "op_max_string": _grouped(
        "customer_id",
        """max(risk_tier) as highest_risk_tier,
  case when bool_or(risk_tier = 'High') then 'High' when bool_or(risk_tier = 'Medium') then 'Medium'
       else 'Low' end as worst_risk_tier""",
    ),
    "op_string_agg": _over_customers(
        "select customer_id, products as product_mix, statuses as loan_statuses from customers"
    ),
    "op_two_level_agg": _over_customers(
        f"""select n as total_loans, count(*) as customer_count,
  {_dbl("sum(borrowed)")} as total_portfolio_value from customers group by n"""
    ),
    "op_mean_of_means": _over_customers(
        f"""select n as total_loans, {MEAN_DPD} as avg_days_past_due,
  {_round("avg(mean_score)", 0)} as avg_risk_score from customers group by n"""
    ),
    "op_avg_nulls": _over(
        [SEQUENCE],
        f"""select loan_number, count(*) as loan_count,
  {_round("avg(date_diff('day', previous_loan_date, origination_date))", 0)} as avg_days_between_loans
from sequence group by loan_number""",
    ),
    "op_median": _over(
        [CUSTOMERS, MEDIANS],
        f"""select {_round("profit_mid", 6)} as median_net_profit, {_round("score_mid", 6)} as median_risk_score
from middle""",
    ),
    "op_row_number": _over([SEQUENCE], "select customer_id, loan_id, loan_number from sequence"),
    "op_lag": _over(
        [SEQUENCE],
        f"""select customer_id, loan_id, loan_number, previous_loan_date,
  {_dbl("previous_loan_amount")} as previous_loan_amount, previous_loan_dpd,
  date_diff('day', previous_loan_date, origination_date) as days_between_loans from sequence""",
    ),
    "op_lag_over_agg": _over(
        [SEQUENCE],
        """select loan_number, count(distinct customer_id) as customer_count,
  lag(count(distinct customer_id)) over (order by loan_number) as previous_count
from sequence group by loan_number""",
    ),
    "op_first_value": _over_loans(
        """select distinct customer_id, first_value(risk_tier) over own as first_risk_tier,
  first_value(risk_score) over own as first_risk_score
from loans window own as (partition by customer_id order by origination_date, loan_id)"""
    ),
    "op_last_value": _over_loans(
        """select distinct customer_id, last_value(risk_tier) over own as latest_risk_tier,
  last_value(risk_score) over own as latest_risk_score
from loans window own as (partition by customer_id order by origination_date, loan_id
  rows between unbounded preceding and unbounded following)"""
    ),
    "op_first_channel": _over(
        [ENDPOINTS],
        "select customer_id, channel as acquisition_channel from endpoints where from_first = 1",
    ),
    "op_share_of_total": _grouped("status", f"count(*) as loan_count, {SHARE} as pct_of_loans"),
    "op_share_of_amount": _grouped(
        "status",
        f"""{_dbl("sum(loan_amount)")} as amount,
  {_pct("sum(loan_amount)", "sum(sum(loan_amount)) over ()")} as pct_of_amount""",
    ),
    "op_sort": _grouped(
        "product_type",
        f"""count(*) as loan_count, {_dbl("sum(loan_amount)")} as portfolio_value,
  {_round(_mean("interest_rate"), 2)} as avg_interest_rate""",
        "portfolio_value desc, product_type",
    ),
    "op_ordinal_sort": _grouped("par_bucket", "count(*) as loan_count", "min(days_past_due)"),
    "op_topk_multi": _over_loans(
        f"""select loan_id, days_past_due, {_dbl("loan_amount")} as loan_amount from loans
order by {DELINQUENCY}, loans.loan_amount desc, loan_id limit 20"""
    ),
    "op_topk": _over_customers(
        f"""select customer_id, {_dbl("borrowed")} as total_borrowed from customers
order by borrowed desc, customer_id limit 20"""
    ),
    "op_distinct": _over_loans("select distinct customer_id, product_type from loans"),
}

BRANCHES = {
    "product_affinity_wide": HEADLINE["product_affinity"].replace(
        "from loans group by customer_id",
        "from (select * replace ('product ' || loan_id % 500 as product_type) from loans) group by customer_id",
        1,
    ),
    "customer_retention_sliced": HEADLINE["customer_retention"],
    "op_row_number_sliced": PRIMITIVES["op_row_number"],
    "customer_segmentation_merged": HEADLINE["customer_segmentation"],
    "product_affinity_merged": HEADLINE["product_affinity"],
    "channel_acquisition_merged": HEADLINE["channel_acquisition"],
    "early_warning_merged": HEADLINE["early_warning"],
    "profitability_matrix_merged": HEADLINE["profitability_matrix"],
    "acquisition_cohorts_merged": HEADLINE["acquisition_cohorts"],
}

ORACLE: dict[str, str] = {**HEADLINE, **UNCUT, **PRIMITIVES, **BRANCHES}
