"""Named SQL fragments and the helper that puts them in front of a query.

Each fragment is one table expression; it may use earlier ones.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-01'"

FRAGMENTS: dict[str, str] = {}

FRAGMENTS["bronze_loans"] = """
select concat(' APP', lpad(cast(o_orderkey as varchar), 12, '0')) as application_id,
       concat('CUST', lpad(cast(o_custkey as varchar), 12, '0'), ' ') as customer_id,
       cast(cast(o_orderdate as date) as varchar) as application_date,
       cast(cast(floor(o_totalprice) as bigint) as varchar) as loan_amount_inr,
       case substr(o_orderpriority, 1, 1)
            when '1' then '12' when '2' then '24' when '3' then '36' when '4' then '60'
            else '84' end as loan_term_months,
       cast(cast(floor(c_acctbal * 60) as bigint) as varchar) as annual_income_inr,
       case c_mktsegment
            when 'BUILDING' then ' Salaried' when 'MACHINERY' then 'SELF_EMPLOYED'
            when 'AUTOMOBILE' then 'contract' when 'FURNITURE' then 'Unemployed '
            else 'salaried' end as employment_type,
       case o_orderkey % 5
            when 0 then 'home_purchase' when 1 then 'Refinance' when 2 then 'auto'
            when 3 then 'PERSONAL' else 'business' end as loan_purpose,
       cast(o_custkey % 6 as varchar) as existing_loans,
       cast(300 + (o_orderkey * 7919 + o_custkey * 104729) % 600 as varchar) as credit_score,
       cast(cast(floor(o_totalprice) as bigint) * (o_orderkey % 25) as varchar)
           as collateral_value,
       case when o_orderstatus = 'P' then null
            when 300 + (o_orderkey * 7919 + o_custkey * 104729) % 600 < 550
                 or (c_acctbal > 0 and o_totalprice > 4 * c_acctbal * 60) then '1'
            else '0' end as default_flag
from orders join customer on o_custkey = c_custkey
"""

FRAGMENTS["bronze_bureau"] = """
select concat('CUST', lpad(cast(o_custkey as varchar), 12, '0')) as customer_id,
       cast(max(cast(o_orderdate as date)) as varchar) as bureau_pull_date,
       cast(300 + (o_custkey * 104729 + year(o_orderdate)) % 600 as varchar) as credit_score,
       cast(count(*) as varchar) as total_accounts,
       cast(count(*) filter (where o_orderstatus = 'O') as varchar) as open_accounts,
       cast(count(*) filter (where o_orderstatus = 'P' and o_orderpriority < '3') as varchar)
           as delinquent_accounts,
       (cast((o_custkey * 997 + year(o_orderdate)) % 130 as double) - 10) / 100
           as credit_utilisation_pct,
       cast(o_custkey * 13 % 240 as varchar) as oldest_account_months,
       cast((o_custkey * 31 + year(o_orderdate)) % 7 as varchar) as hard_inquiries_6m,
       cast(cast(sum(floor(o_totalprice)) as bigint) as varchar) as total_credit_limit_inr,
       cast(cast(sum(case when o_orderstatus = 'O' then floor(o_totalprice) else 0 end)
            as bigint) as varchar) as total_balance_inr
from orders
where o_custkey % 11 <> 0
group by o_custkey, year(o_orderdate)
"""

FRAGMENTS["bronze_txn"] = """
select concat('TXN', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar))
           as transaction_id,
       concat('CUST', lpad(cast(o_custkey as varchar), 12, '0')) as customer_id,
       cast(cast(l_shipdate as date) as varchar) as transaction_date,
       cast(cast(floor(l_extendedprice) as bigint) as varchar) as amount_inr,
       case (l_orderkey + l_linenumber) % 6
            when 0 then 'debit' when 1 then 'credit' when 2 then 'transfer'
            when 3 then 'EMI_Payment ' when 4 then 'atm_withdrawal' else 'pos'
       end as transaction_type,
       cast((l_orderkey * 7919 + l_linenumber * 31) % 2000000 as varchar) as balance_after_inr,
       case when (l_orderkey * 13 + l_linenumber) % 33 = 0 then '1' else '0' end as is_flagged
from lineitem join orders on l_orderkey = o_orderkey
"""

FRAGMENTS["predictions"] = """
with versions as (
    select o_orderkey, o_custkey, cast(o_orderdate as date) as day,
           unnest(generate_series(0, o_orderkey % 3)) as v
    from orders
), scores as (
    select *, cast((o_orderkey * 7919 + o_custkey * 31 + v * 613) % 10000 as double) / 10000 rf,
           cast((o_orderkey * 104729 + o_custkey * 17 + v * 271) % 10000 as double) / 10000 lr
    from versions
), blended as (
    select *, round(rf * 0.7::double + lr * 0.3::double, 6) as ens from scores
)
select concat('APP', lpad(cast(o_orderkey as varchar), 12, '0')) as application_id,
       concat('CUST', lpad(cast(o_custkey as varchar), 12, '0')) as customer_id,
       rf as pd_probability_rf, lr as pd_probability_lr, ens as pd_probability_ens,
       case when ens >= 0.5 then 1 else 0 end as pd_prediction,
       case when ens < 0.05 then 'A' when ens < 0.15 then 'B' when ens < 0.3 then 'C'
            when ens < 0.5 then 'D' else 'E' end as risk_grade,
       concat('v', cast(v as varchar)) as model_version,
       cast(day + cast(v as integer) as timestamp) as scored_at
from blended
"""

FRAGMENTS["stg_loans"] = """
with typed as (
    select trim(application_id) as application_id, trim(customer_id) as customer_id,
           application_date::date as application_date,
           loan_amount_inr::bigint as loan_amount_inr,
           annual_income_inr::bigint as annual_income_inr,
           loan_term_months::integer as loan_term_months,
           existing_loans::integer as existing_loans,
           collateral_value::bigint as collateral_value_inr,
           credit_score::integer as credit_score,
           lower(trim(employment_type)) as employment_type,
           lower(trim(loan_purpose)) as loan_purpose,
           default_flag::integer as default_flag
    from bronze_loans
    where application_id is not null and customer_id is not null
      and annual_income_inr::bigint > 0
)
select *,
       round(loan_amount_inr::double / annual_income_inr, 4) as loan_to_income_ratio,
       if(loan_amount_inr > 0, round(collateral_value_inr::double / loan_amount_inr, 4), null)
           as collateral_coverage_ratio,
       if(credit_score >= 750, 'low', if(credit_score >= 600, 'medium',
          if(credit_score >= 450, 'high', 'very_high'))) as credit_risk_tier
from typed
qualify row_number() over (partition by application_id order by application_date desc) = 1
"""

FRAGMENTS["stg_credit"] = """
with typed as (
    select trim(customer_id) as customer_id, bureau_pull_date::date as bureau_pull_date,
           credit_score::integer as credit_score, total_accounts::integer as total_accounts,
           open_accounts::integer as open_accounts,
           delinquent_accounts::integer as delinquent_accounts,
           hard_inquiries_6m::integer as hard_inquiries_6m,
           oldest_account_months::integer as oldest_account_months,
           total_credit_limit_inr::bigint as total_credit_limit_inr,
           total_balance_inr::bigint as total_balance_inr,
           credit_utilisation_pct as raw_util
    from bronze_bureau where customer_id is not null
), newest as (
    select * from typed
    qualify row_number() over (
        partition by customer_id order by bureau_pull_date desc nulls first) = 1
)
select * exclude (raw_util),
       if(raw_util is null or raw_util > 1, 1.0::double, if(raw_util < 0, 0.0::double, raw_util))
           as credit_utilisation_pct,
       coalesce(if(total_balance_inr > total_credit_limit_inr, 0::bigint,
                   total_credit_limit_inr - total_balance_inr), 0::bigint)
           as available_credit_inr,
       if(raw_util < 0.3, 'low', if(raw_util < 0.6, 'medium',
          if(raw_util < 0.9, 'high', 'maxed_out'))) as utilisation_band,
       if(hard_inquiries_6m >= 3, 1, 0) as high_inquiry_flag,
       if(total_accounts > 0, round(delinquent_accounts::double / total_accounts, 4), 0.0::double)
           as delinquency_rate,
       if(oldest_account_months < 12, 'new', if(oldest_account_months < 36, 'developing',
          if(oldest_account_months < 84, 'established', 'mature'))) as credit_age_band
from newest
"""

FRAGMENTS["feat_dti_ratio"] = """
with j as (
    select l.application_id, l.customer_id, l.application_date, l.annual_income_inr,
           l.loan_amount_inr, l.loan_term_months, l.existing_loans, l.employment_type,
           l.loan_purpose, l.credit_score, l.loan_to_income_ratio, l.collateral_coverage_ratio,
           l.credit_risk_tier, l.default_flag,
           ifnull(c.total_balance_inr, 0::bigint) as bureau_total_balance_inr,
           ifnull(c.total_credit_limit_inr, 0::bigint) as bureau_credit_limit_inr,
           ifnull(c.credit_utilisation_pct, 0::double) as bureau_utilisation_pct,
           ifnull(c.delinquent_accounts, 0) as delinquent_accounts,
           ifnull(c.hard_inquiries_6m, 0) as hard_inquiries_6m,
           ifnull(c.delinquency_rate, 0::double) as delinquency_rate,
           ifnull(c.high_inquiry_flag, 0) as high_inquiry_flag,
           ifnull(c.utilisation_band, 'unknown') as utilisation_band,
           if(c.customer_id is null, 1, 0) as no_bureau_record_flag
    from stg_loans l left join stg_credit c on c.customer_id = l.customer_id
), m as (
    select *, round(annual_income_inr::double / 12, 2) as monthly_income_inr,
           if(loan_term_months > 0, round(loan_amount_inr::double / loan_term_months, 2), null)
               as estimated_monthly_emi_inr,
           round(bureau_total_balance_inr::double / 60, 2) as bureau_monthly_burden_inr
    from j
), t as (
    select *, round(ifnull(estimated_monthly_emi_inr, 0::double) + bureau_monthly_burden_inr, 2)
               as total_monthly_debt_inr
    from m
), d as (
    select *, if(monthly_income_inr > 0,
                 round(round(total_monthly_debt_inr * 100) / round(monthly_income_inr * 100), 4),
                 null) as dti_ratio
    from t
)
select *, if(dti_ratio is null, 'unknown', if(dti_ratio < 0.36, 'low',
             if(dti_ratio < 0.43, 'moderate', if(dti_ratio < 0.5, 'elevated', 'high'))))
              as dti_risk_tier,
       if(dti_ratio >= 0.5 and high_inquiry_flag = 1, 1, 0) as combined_risk_flag
from d
"""

FRAGMENTS["monthly_spend"] = f"""
with recent as (
    select customer_id, cast(date_trunc('month', transaction_date::date) as date) as txn_month,
           amount_inr::bigint as amount, lower(trim(transaction_type)) as kind,
           balance_after_inr::bigint as balance, is_flagged::integer as flagged
    from bronze_txn
    where customer_id is not null
      and transaction_date::date >= cast({AS_OF} - interval 12 month as date)
      and transaction_date::date <= {AS_OF}
)
select customer_id, txn_month,
       cast(coalesce(sum(amount) filter (where kind in ('debit', 'atm_withdrawal', 'pos')), 0)
            as bigint) as monthly_debit_spend_inr,
       cast(coalesce(sum(amount) filter (where kind = 'emi_payment'), 0) as bigint)
           as monthly_emi_paid_inr,
       count(*) filter (where kind = 'emi_payment') as emi_payment_count,
       avg(balance) as avg_balance_inr,
       cast(sum(flagged) as bigint) as flagged_txn_count,
       count(*) as total_txn_count
from recent group by customer_id, txn_month
"""

_RECENT_FROM = f"cast(date_trunc('month', {AS_OF}) - interval 3 month as date)"

FRAGMENTS["customer_txn_agg"] = f"""
select customer_id,
       round(avg(monthly_debit_spend_inr), 2) as avg_monthly_spend_inr,
       round(stddev_samp(monthly_debit_spend_inr), 2) as spend_volatility_inr,
       cast(max(monthly_debit_spend_inr) as double) as peak_monthly_spend_inr,
       cast(sum(emi_payment_count) as bigint) as emi_payment_count_12m,
       cast(sum(monthly_emi_paid_inr) as bigint) as total_emi_paid_inr_12m,
       round(count(*) filter (where emi_payment_count > 0)::double / count(*), 4)
           as emi_regularity_score,
       avg(avg_balance_inr) filter (where txn_month >= {_RECENT_FROM}) as avg_balance_recent_3m,
       avg(avg_balance_inr) filter (where txn_month < {_RECENT_FROM}) as avg_balance_earlier_9m,
       cast(sum(flagged_txn_count) as bigint) as total_flagged_txns,
       cast(sum(total_txn_count) as bigint) as total_txns_12m,
       count(distinct txn_month) as active_months_count
from monthly_spend group by customer_id
"""

FRAGMENTS["feat_credit_util"] = """
with j as (
    select c.customer_id, c.bureau_pull_date, c.credit_score,
           c.credit_utilisation_pct as bureau_utilisation_pct, c.total_credit_limit_inr,
           c.total_balance_inr as bureau_balance_inr, c.utilisation_band, c.high_inquiry_flag,
           c.delinquency_rate, c.available_credit_inr, c.credit_age_band,
           ifnull(t.avg_monthly_spend_inr, 0::double) as avg_monthly_spend_inr,
           ifnull(t.spend_volatility_inr, 0::double) as spend_volatility_inr,
           ifnull(t.peak_monthly_spend_inr, 0::double) as peak_monthly_spend_inr,
           ifnull(t.emi_payment_count_12m, 0::bigint) as emi_payment_count_12m,
           ifnull(t.total_emi_paid_inr_12m, 0::bigint) as total_emi_paid_inr_12m,
           ifnull(t.emi_regularity_score, 0::double) as emi_regularity_score,
           ifnull(t.avg_balance_recent_3m, 0::double) as avg_balance_recent_3m,
           ifnull(t.avg_balance_earlier_9m, 0::double) as avg_balance_earlier_9m,
           ifnull(t.total_flagged_txns, 0::bigint) as total_flagged_txns,
           ifnull(t.total_txns_12m, 0::bigint) as total_txns_12m,
           ifnull(t.active_months_count, 0::bigint) as active_months_count,
           if(t.customer_id is null, 1, 0) as no_txn_history_flag
    from stg_credit c left join customer_txn_agg t on t.customer_id = c.customer_id
), e as (
    select *, if(avg_balance_earlier_9m > 0 and avg_balance_recent_3m > avg_balance_earlier_9m,
                 1, 0) as balance_trend_flag,
           if(total_credit_limit_inr > 0,
              round(round(avg_monthly_spend_inr * 100) / (total_credit_limit_inr * 100), 4), null)
               as txn_utilisation_estimate,
           if(total_txns_12m > 0, round(total_flagged_txns::double / total_txns_12m, 4),
              0::double) as flagged_txn_rate
    from j
)
select *, if(txn_utilisation_estimate > round(bureau_utilisation_pct + 0.15::double, 10), 1, 0)
              as utilisation_change_flag,
       high_inquiry_flag + balance_trend_flag + if(emi_regularity_score < 0.5, 1, 0)
           + if(flagged_txn_rate > 0.05, 1, 0) as credit_stress_score
from e
"""

FRAGMENTS["scoring_frame"] = """
select d.application_id, d.customer_id, d.application_date, d.loan_amount_inr,
       d.annual_income_inr, d.loan_term_months, d.existing_loans, d.collateral_coverage_ratio,
       d.loan_to_income_ratio, d.credit_score, d.employment_type, d.loan_purpose, d.dti_ratio,
       d.dti_risk_tier, d.credit_risk_tier, d.monthly_income_inr, d.estimated_monthly_emi_inr,
       d.bureau_monthly_burden_inr, d.total_monthly_debt_inr, d.delinquency_rate,
       d.hard_inquiries_6m, d.combined_risk_flag, d.no_bureau_record_flag,
       ifnull(u.bureau_utilisation_pct, 0::double) as bureau_utilisation_pct,
       ifnull(u.avg_monthly_spend_inr, 0::double) as avg_monthly_spend_inr,
       ifnull(u.spend_volatility_inr, 0::double) as spend_volatility_inr,
       ifnull(u.emi_payment_count_12m, 0::bigint) as emi_payment_count_12m,
       ifnull(u.emi_regularity_score, 0::double) as emi_regularity_score,
       ifnull(u.credit_stress_score, 0) as credit_stress_score,
       ifnull(u.flagged_txn_rate, 0::double) as flagged_txn_rate,
       ifnull(u.total_txns_12m, 0::bigint) as total_txns_12m,
       ifnull(u.balance_trend_flag, 0) as balance_trend_flag,
       ifnull(u.utilisation_change_flag, 0) as utilisation_change_flag,
       ifnull(u.utilisation_band, 'unknown') as utilisation_band,
       ifnull(u.credit_age_band, 'unknown') as credit_age_band,
       d.default_flag
from feat_dti_ratio d left join feat_credit_util u on u.customer_id = d.customer_id
"""

FRAGMENTS["training_frame"] = "select * from scoring_frame where default_flag is not null"

FRAGMENTS["latest"] = """
select * from predictions
qualify row_number() over (partition by application_id order by scored_at desc) = 1
"""

FRAGMENTS["latest_context"] = """
select p.*, d.loan_amount_inr, d.annual_income_inr, d.employment_type, d.loan_purpose,
       d.credit_score, d.loan_to_income_ratio, d.dti_ratio, d.dti_risk_tier, d.credit_risk_tier
from latest p left join feat_dti_ratio d on d.application_id = p.application_id
"""

FRAGMENTS["labelled_scores"] = """
select p.application_id, p.pd_probability_rf, p.pd_probability_lr, p.pd_probability_ens,
       p.pd_prediction, p.model_version, l.default_flag
from predictions p join stg_loans l on l.application_id = p.application_id
where l.default_flag is not null
"""


def sql(body: str, **extra: str) -> str:
    """``body`` with a WITH clause of every fragment it needs, directly or indirectly."""
    known = {**FRAGMENTS, **extra}
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in known:
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                visit(known[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} as ({known[n].strip()})" for n in needed)
    return f"with {ctes}\n{body.strip()}"
