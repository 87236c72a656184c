"""DuckDB SQL per registered query."""

from __future__ import annotations

from oracle.given_tables import FRAGMENTS, sql

ORACLE: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _counts(table: str, *columns: str) -> str:
    names = ", ".join(columns)
    return sql(f"select {names}, count(*) as n from {table} group by {names}")


for _name in ("stg_loans", "stg_credit", "feat_dti_ratio", "scoring_frame", "training_frame"):
    ORACLE[_name] = sql(f"select * from {_name}")

ORACLE["credit_tier_mix"] = _counts("stg_loans", "credit_risk_tier")
ORACLE["dti_tier_mix"] = _counts("feat_dti_ratio", "dti_risk_tier", "combined_risk_flag")
ORACLE["stress_mix"] = _counts("feat_credit_util", "credit_stress_score")
ORACLE["monthly_spend"] = sql(
    "select * replace (round(avg_balance_inr, 6) as avg_balance_inr) from monthly_spend"
)
ORACLE["relanded_spend"] = ORACLE["merged_spend"] = ORACLE["monthly_spend"]
for _name in ("customer_txn_agg", "feat_credit_util"):
    ORACLE[_name] = sql(
        f"""select * replace (round(avg_balance_recent_3m, 6) as avg_balance_recent_3m,
                              round(avg_balance_earlier_9m, 6) as avg_balance_earlier_9m)
            from {_name}"""
    )

# --------------------------------------------------------------------------- quality

_LOANS, _CREDIT = "stg_loans", "stg_credit"


def _not_null(table: str, column: str) -> str:
    return (
        f"select '{table}' t, '{column}' c, 'not_null' k, "
        f"(select count(*) from {{{table}}} where {column} is null) f"
    )


def _unique(table: str, column: str) -> str:
    return (
        f"select '{table}' t, '{column}' c, 'unique' k, (select count(*) from (select {column} "
        f"from {{{table}}} where {column} is not null group by 1 having count(*) > 1)) f"
    )


def _accepted(table: str, column: str, *values) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return (
        f"select '{table}' t, '{column}' c, 'accepted_values' k, (select count(*) "
        f"from {{{table}}} where cast({column} as varchar) not in ({listed})) f"
    )


def _range(table: str, column: str, low, high) -> str:
    return (
        f"select '{table}' t, '{column}' c, 'accepted_range' k, (select count(*) "
        f"from {{{table}}} where not cast({column} as double) between {low} and {high}) f"
    )


def _stamp(table: str, column: str) -> str:
    """The processing time is always set; the SQL tables do not carry it."""
    return f"select '{table}' t, '{column}' c, 'not_null' k, 0::bigint f"


_SILVER = [
    _unique("stg_loans", "application_id"),
    *[
        _not_null("stg_loans", c)
        for c in (
            "application_id",
            "customer_id",
            "application_date",
            "loan_amount_inr",
            "annual_income_inr",
        )
    ],
    _stamp("stg_loans", "silver_processed_at"),
    _accepted("stg_loans", "credit_risk_tier", "low", "medium", "high", "very_high"),
    _accepted(
        "stg_loans", "employment_type", "salaried", "self_employed", "contract", "unemployed"
    ),
    _accepted("stg_loans", "default_flag", 0, 1),
    _unique("stg_credit", "customer_id"),
    _not_null("stg_credit", "customer_id"),
    _not_null("stg_credit", "credit_utilisation_pct"),
    _stamp("stg_credit", "silver_processed_at"),
    _accepted("stg_credit", "utilisation_band", "low", "medium", "high", "maxed_out"),
    _accepted("stg_credit", "high_inquiry_flag", 0, 1),
    _accepted("stg_credit", "credit_age_band", "new", "developing", "established", "mature"),
    _unique("feat_dti_ratio", "application_id"),
    _not_null("feat_dti_ratio", "application_id"),
    _not_null("feat_dti_ratio", "customer_id"),
    _stamp("feat_dti_ratio", "feature_computed_at"),
    _accepted("feat_dti_ratio", "dti_risk_tier", "low", "moderate", "elevated", "high", "unknown"),
    _accepted("feat_dti_ratio", "combined_risk_flag", 0, 1),
    _unique("feat_credit_util", "customer_id"),
    _not_null("feat_credit_util", "customer_id"),
    _stamp("feat_credit_util", "feature_computed_at"),
    _accepted("feat_credit_util", "utilisation_change_flag", 0, 1),
    _accepted("feat_credit_util", "balance_trend_flag", 0, 1),
]
_BRONZE = [
    _unique("loan_applications", "application_id"),
    *[
        _not_null("loan_applications", c)
        for c in (
            "application_id",
            "customer_id",
            "loan_amount_inr",
            "annual_income_inr",
            "credit_score",
        )
    ],
    _range("loan_applications", "credit_score", 300, 900),
    _accepted("loan_applications", "default_flag", 0, 1),
    _not_null("credit_bureau", "customer_id"),
    _range("credit_bureau", "credit_utilisation_pct", 0, 1),
    _not_null("credit_bureau", "credit_score"),
    _unique("transactions", "transaction_id"),
    _not_null("transactions", "transaction_id"),
    _not_null("transactions", "customer_id"),
    _not_null("transactions", "amount_inr"),
]
_FROM = {
    "stg_loans": "stg_loans",
    "stg_credit": "stg_credit",
    "feat_dti_ratio": "feat_dti_ratio",
    "feat_credit_util": "feat_credit_util",
    "loan_applications": "bronze_loans",
    "credit_bureau": "bronze_bureau",
    "transactions": "bronze_txn",
}


def _report(checks: list[str]) -> str:
    union = "\nunion all ".join(c.format(**_FROM) for c in checks)
    return (
        "select t as table_name, c as column_name, k as check_kind, f as failures, "
        f"if(f = 0, 'pass', 'fail') as status from ({union})"
    )


ORACLE["dq_report"] = sql(_report(_SILVER + _BRONZE))
ORACLE["dq_summary"] = sql(
    f"""select 4 as models_run, count(*) filter (where status = 'pass') as tests_passed,
               count(*) filter (where status = 'fail') as tests_failed,
               if(count(*) filter (where status = 'fail') = 0, 'success', 'partial') as status
        from ({_report(_SILVER)})"""
)
ORACLE["dq_failing_values"] = sql(
    "select transaction_id, count(*) as n from bronze_txn group by 1 having count(*) > 1"
)
ORACLE["dq_incremental_failing"] = ORACLE["dq_failing_values"]

# --------------------------------------------------------------------------- training set

NUMERIC = (
    "loan_amount_inr annual_income_inr loan_term_months existing_loans "
    "collateral_coverage_ratio loan_to_income_ratio credit_score dti_ratio monthly_income_inr "
    "estimated_monthly_emi_inr bureau_monthly_burden_inr total_monthly_debt_inr "
    "delinquency_rate hard_inquiries_6m bureau_utilisation_pct avg_monthly_spend_inr "
    "spend_volatility_inr emi_payment_count_12m emi_regularity_score credit_stress_score "
    "flagged_txn_rate total_txns_12m"
).split()
CATEGORIES = (
    "employment_type loan_purpose dti_risk_tier credit_risk_tier utilisation_band "
    "credit_age_band"
).split()

ORACLE["default_rate_by"] = sql(
    """select credit_risk_tier, dti_risk_tier, count(*) as n,
              round(avg(default_flag) * 100, 4) as default_rate_pct
       from feat_dti_ratio where default_flag is not null group by 1, 2"""
)
ORACLE["feature_nulls"] = sql(
    " union all ".join(
        f"select '{c}' as feature, count(*) - count({c}) as null_count from training_frame"
        for c in NUMERIC
    )
)
ORACLE["feature_medians"] = sql(
    " union all ".join(
        f"select '{c}' as feature, median({c}::double) as median_value from training_frame"
        for c in NUMERIC
    )
)
FRAGMENTS["dealt_folds"] = """
select *, cast((row_number() over (partition by default_flag
                order by sha256(application_id || '#42'), application_id) - 1) % 5 as integer) as fold
from training_frame
"""
ORACLE["fold_medians"] = sql(
    " union all ".join(
        f"select cast(f as integer) as fold, '{c}' as feature, median({c}::double) as median_value "
        "from dealt_folds join (select unnest(range(5)) as f) on f <> fold group by f"
        for c in NUMERIC
    )
)
ORACLE["imputed_features"] = sql(
    "select application_id, "
    + ", ".join(
        f"coalesce({c}::double, (select median({c}::double) from training_frame)) as {c}"
        for c in NUMERIC
    )
    + ", "
    + ", ".join(f"coalesce({c}, 'unknown') as {c}" for c in CATEGORIES)
    + " from scoring_frame"
)
_LEVELS = {
    "employment_type": ["contract", "salaried", "self_employed", "unemployed"],
    "loan_purpose": ["auto", "business", "home_purchase", "personal", "refinance"],
    "credit_risk_tier": ["high", "low", "medium", "very_high"],
}
ORACLE["one_hot"] = sql(
    "select application_id, "
    + ", ".join(f"if({c} = '{v}', 1, 0) as {c}_{v}" for c, vs in _LEVELS.items() for v in vs)
    + " from scoring_frame"
)
ORACLE["class_weights"] = sql(
    """select default_flag, count(*) as n,
              round((select count(*) from training_frame)::double
                    / ((select count(distinct default_flag) from training_frame) * count(*)), 8)
                  as class_weight
       from training_frame group by default_flag"""
)
ORACLE["time_split"] = sql(
    """select application_id, application_date,
              if(row_number() over (order by application_date, application_id)
                 <= floor(0.8 * count(*) over ()), 'train', 'test') as split
       from training_frame"""
)
ORACLE["cv_folds"] = sql(
    """select default_flag, fold, count(*) as n, min(application_id) as first_application from (
           select application_id, default_flag,
                  cast((row_number() over (partition by default_flag
                        order by sha256(application_id || '#42'), application_id) - 1) % 5
                       as integer) as fold
           from training_frame) group by default_flag, fold"""
)

# --------------------------------------------------------------------------- serving

ORACLE["latest_prediction"] = sql("select * from latest_context")
ORACLE["grade_distribution"] = sql(
    """select risk_grade, count(*) as "count", round(avg(pd_probability_ens), 6) as avg_pd,
              min(pd_probability_ens) as min_pd, max(pd_probability_ens) as max_pd
       from predictions group by risk_grade"""
)
ORACLE["portfolio_kpis"] = sql(
    """select count(*) as total_applications,
              round(coalesce(avg(pd_probability_ens), 0), 6) as portfolio_avg_pd,
              count(*) filter (where risk_grade in ('D', 'E')) as high_risk_count,
              round(count(*) filter (where risk_grade in ('D', 'E')) * 100::double / count(*), 6)
                  as high_risk_pct
       from predictions"""
)
ORACLE["pd_trend"] = sql(
    """select cast(scored_at as date) as day, round(avg(pd_probability_ens), 6) as avg_pd,
              count(*) as scored_count
       from predictions group by 1 order by 1 desc limit 30"""
)
_SHARES = ", ".join(
    f"round(count(*) filter (where risk_grade = '{g}') * 100::double / count(*), 2) "
    f"as pct_grade_{g.lower()}"
    for g in "ABCDE"
)
ORACLE["grade_shares"] = sql(f"select {_SHARES} from predictions")
ORACLE["model_agreement"] = sql(
    """select model_version, count(*) as n, count(*) filter (where agree) as agreeing,
              round(avg(agree::int), 6) as agreement_share
       from (select model_version,
                    round(abs(pd_probability_rf - pd_probability_lr), 6) < 0.1 as agree
             from predictions) group by model_version"""
)
ORACLE["customer_profile"] = sql(
    """select *, row_number() over (partition by customer_id
                                    order by scored_at desc, application_id) as application_rank
       from latest_context"""
)
ORACLE["risk_grade"] = sql(
    """select model_version, grade, count(*) as n, min(pd) as min_pd, max(pd) as max_pd
       from (select model_version, pd_probability_rf as pd,
                    if(pd < 0.05, 'A', if(pd < 0.15, 'B', if(pd < 0.3, 'C',
                       if(pd < 0.5, 'D', 'E')))) as grade from predictions) group by 1, 2"""
)
ORACLE["pd_label"] = sql(
    """select model_version, label, count(*) as n, min(pd) as min_pd, max(pd) as max_pd
       from (select model_version, pd_probability_ens as pd,
                    if(pd >= 0.7, 'VERY HIGH', if(pd >= 0.5, 'HIGH',
                       if(pd >= 0.3, 'MEDIUM', 'LOW'))) as label from predictions)
       group by 1, 2"""
)

FRAGMENTS["rule"] = """
select *, printf('%.1f%%', pd_probability_ens * 100) as pd_text,
       ifnull(dti_risk_tier, 'unknown') as tier,
       case when risk_grade in ('D', 'E') then 'grade'
            when ifnull(dti_risk_tier, '') = 'high' then 'dti'
            when credit_score < 550 then 'score'
            when risk_grade in ('A', 'B') and ifnull(dti_risk_tier, '') in ('low', 'moderate')
                then 'approve'
            else 'refer' end as fired
from latest_context
"""
FRAGMENTS["decided"] = """
select *,
       case fired when 'approve' then 'APPROVE' when 'refer' then 'REFER' else 'DECLINE' end
           as decision,
       case when fired = 'approve' and (dti_ratio is not null or credit_score is not null)
            then 'high' else 'medium' end as confidence,
       case fired
         when 'grade' then concat('Risk grade ', risk_grade, ' (PD ', pd_text,
              ') exceeds acceptable default probability threshold for approval.')
         when 'dti' then concat('DTI ratio ', printf('%.2f', dti_ratio),
              ' classified as high risk (>=0.50), exceeding RBI prudential threshold.')
         when 'score' then concat('Credit score ', printf('%.0f', credit_score::double),
              ' falls below the minimum threshold of 550 for any product line.')
         when 'approve' then concat_ws(' | ',
              concat('Risk grade ', risk_grade, ' (PD ', pd_text,
                     ') falls within standard approval threshold.'),
              'DTI ratio ' || printf('%.2f', dti_ratio) || ' classified as ' || tier
                  || ' risk, within approval bounds.',
              'Credit score ' || printf('%.0f', credit_score::double)
                  || ' meets minimum product requirements.')
         else concat('Risk grade ', risk_grade, ' (PD ', pd_text, ') combined with DTI tier ''',
              tier, ''' requires senior credit officer review.') end as reasoning,
       case fired
         when 'grade' then 'Basel III PD Risk Grade D/E — decline recommended'
         when 'dti' then 'RBI DTI threshold — Section 4, high risk >= 50%'
         when 'score' then 'RBI Section 5 — minimum credit score requirement'
         when 'approve' then 'Basel III PD Risk Grade A/B — standard approval | RBI DTI threshold — low/moderate risk band'
         else 'Basel III PD Risk Grade C — enhanced monitoring' end as policy_refs
from rule
"""
ORACLE["decisions"] = sql(
    """select application_id, customer_id, risk_grade, pd_probability_ens, decision, confidence
       from decided"""
)
ORACLE["decision_reasons"] = sql(
    "select application_id, decision, reasoning, policy_refs from decided"
)
ORACLE["decision_mix"] = sql(
    """select decision, risk_grade, count(*) as n, round(avg(pd_probability_ens), 6) as avg_pd
       from decided group by 1, 2"""
)
ORACLE["batch_score"] = sql(
    """with asked as (
           select upper(trim(case l_linenumber
                when 7 then concat('zzz', l_orderkey) when 6 then '  '
                else concat(' app', lpad(cast(l_orderkey as varchar), 12, '0')) end)) as id
           from lineitem)
       select id as application_id, customer_id, pd_probability_rf, pd_probability_lr,
              pd_probability_ens, risk_grade, decision, confidence,
              ifnull(reasoning, '') as reasoning,
              if(d.application_id is null, id || ' not found', '') as error
       from asked left join decided d on d.application_id = id
       where id <> ''""".replace("with asked as (", "select * from (with asked as (")
    + ")"
)

# --------------------------------------------------------------------------- metrics, drift

FRAGMENTS["by_ens"] = """
select pd_probability_ens as score, count(*) filter (where default_flag = 1) as pos,
       count(*) filter (where default_flag = 0) as neg
from labelled_scores group by 1
"""
FRAGMENTS["by_rf"] = FRAGMENTS["by_ens"].replace("pd_probability_ens", "pd_probability_rf")
FRAGMENTS["totals"] = """
select count(*) filter (where default_flag = 1) as p,
       count(*) filter (where default_flag = 0) as n from labelled_scores
"""
ORACLE["roc_auc"] = sql(
    """select cast(any_value(p) as bigint) as positives, cast(any_value(n) as bigint) as negatives,
              round(sum(pos * (below + neg / 2.0::double)) / (any_value(p)::double * any_value(n)),
                    8) as auc
       from (select *, coalesce(sum(neg) over (order by score
                        rows between unbounded preceding and 1 preceding), 0)::double as below
             from by_ens), totals"""
)
ORACLE["avg_precision"] = sql(
    """select any_value(p) as positives,
              round(sum(pos * (tp::double / (tp + fp))) / any_value(p), 8) as average_precision
       from (select *, sum(pos) over (order by score desc) as tp,
                    sum(neg) over (order by score desc) as fp from by_ens), totals"""
)
_POINTS = """(select *, sum(pos) over (order by score desc) as tp,
                     sum(neg) over (order by score desc) as fp from by_rf), totals"""
ORACLE["roc_points"] = sql(
    f"""select score as threshold, round(fp::double / n, 8) as fpr, round(tp::double / p, 8) as tpr
        from {_POINTS} union all select null, 0, 0"""
)
ORACLE["pr_points"] = sql(
    f"""select score as threshold, round(tp::double / (tp + fp), 8) as precision,
               round(tp::double / p, 8) as recall
        from {_POINTS} union all select null, 1, 0"""
)
ORACLE["classification_report"] = sql(
    """select * from (with c as (
           select count(*) filter (where l = 0 and y = 0)::double h0,
                  count(*) filter (where l = 1 and y = 1)::double h1,
                  count(*) filter (where y = 0)::double s0, count(*) filter (where y = 1)::double s1,
                  count(*) filter (where l = 0)::double w0, count(*) filter (where l = 1)::double w1
           from (select default_flag l, pd_prediction y from labelled_scores)),
       m as (select *, h0 / s0 p0, h1 / s1 p1, h0 / w0 r0, h1 / w1 r1,
                    2 * h0 / (s0 + w0) f0, 2 * h1 / (s1 + w1) f1, (h0 + h1) / (w0 + w1) acc from c),
       r as (select 'no_default' as class, p0 as p, r0 as r, f0 as f, w0 as s from m
             union all select 'default', p1, r1, f1, w1 from m
             union all select 'accuracy', acc, acc, acc, w0 + w1 from m
             union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, w0 + w1
             from m
             union all select 'weighted avg', (p0 * w0 + p1 * w1) / (w0 + w1),
                (r0 * w0 + r1 * w1) / (w0 + w1), (f0 * w0 + f1 * w1) / (w0 + w1), w0 + w1 from m)
       select class, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1_score,
              cast(s as bigint) as support from r)"""
)


def _ks(in_a: str, in_b: str) -> str:
    """One row d, n, m of a two-sample comparison over the predictions."""
    return f"""
    select max(abs(ca / n - cb / m)) as d, any_value(n) as n, any_value(m) as m from (
        select sum(a) over (order by v)::double as ca, sum(b) over (order by v)::double as cb,
               (sum(a) over ())::double as n, (sum(b) over ())::double as m
        from (select pd_probability_ens as v, count(*) filter (where {in_a}) as a,
                     count(*) filter (where {in_b}) as b
              from predictions where ({in_a}) or ({in_b}) group by 1))"""


_P_VALUE = """
    if(d <= 0, 1::double, greatest(0::double, least(1::double, 2 * list_sum(list_transform(
        generate_series(1, 100), lambda k:
            if(k % 2 = 1, 1, -1) * exp(-2::double * k * k * d * d * (n * m / (n + m))))))))"""
_FIRST, _LAST = "year(scored_at) = 1995", "year(scored_at) = 2001"
ORACLE["ks_two_sample"] = sql(
    f"""select cast(n as bigint) as n_baseline, cast(m as bigint) as n_current,
               round(d, 6) as ks_statistic, round({_P_VALUE}, 6) as ks_pvalue
        from ({_ks(_FIRST, _LAST)})"""
)
ORACLE["drift_baseline"] = sql(
    """select * from predictions
       where cast(scored_at as date) = (select min(cast(scored_at as date)) from predictions)"""
)
_YMIN = "year(scored_at) = (select min(year(scored_at)) from predictions)"
_YMAX = "year(scored_at) = (select max(year(scored_at)) from predictions)"
ORACLE["drift_snapshot"] = sql(
    f"""select max(model_version) as model_version, DATE '2001-08-01' as snapshot_date,
               count(*) as total_scored, round(avg(pd_probability_ens), 6) as avg_pd,
               round(stddev_pop(pd_probability_ens), 6) as std_pd, {_SHARES},
               any_value(ks) as ks_statistic, any_value(p) as ks_pvalue,
               any_value(p) <= 0.05 and any_value(ks) >= 0.05 as drift_detected,
               if(any_value(p) > 0.05 or any_value(ks) < 0.05, 'none',
                  if(any_value(ks) < 0.1, 'minor',
                     if(any_value(ks) < 0.2, 'moderate', 'severe'))) as drift_severity
        from predictions,
             (select round(d, 6) as ks, round({_P_VALUE}, 6) as p from ({_ks(_YMIN, _YMAX)}))
        where {_YMAX}"""
)

ORACLE["upsert_latest"] = sql(
    """select * from (with t as (select * from predictions where model_version <> 'v2'),
            u as (select *, round(1 - pd_probability_ens, 6) as flipped from predictions
                  where model_version <> 'v0')
       select coalesce(t.application_id, u.application_id) as application_id,
              coalesce(t.model_version, u.model_version) as model_version,
              coalesce(u.flipped, t.pd_probability_ens) as pd_probability_ens,
              if(u.flipped is null, t.risk_grade, if(u.flipped < 0.05, 'A',
                 if(u.flipped < 0.15, 'B', if(u.flipped < 0.3, 'C',
                 if(u.flipped < 0.5, 'D', 'E'))))) as risk_grade,
              coalesce(t.scored_at, u.scored_at) as scored_at
       from t full join u on u.application_id = t.application_id
                          and u.model_version = t.model_version)"""
)
FRAGMENTS["score_points"] = """
select period, value, upto, n, total
from (select *, cast(sum(n) over (partition by period order by value) as bigint) as upto,
             cast(sum(n) over (partition by period) as bigint) as total
      from (select cast(date_trunc('month', scored_at) as date) as period,
                   pd_probability_ens as value, count(*) as n
            from predictions where scored_at is not null and pd_probability_ens is not null
            group by 1, 2))
where floor(upto * 100 / total) > floor((upto - n) * 100 / total)
"""
ORACLE["drift_states"] = sql("select * from score_points")
ORACLE["drift_state_gaps"] = sql(
    """select a, b, round(max(abs(coalesce(fa, 0) - coalesce(fb, 0))), 9) as gap
       from (select a, b,
                    max(case when side = 0 then upto / total end) over w as fa,
                    max(case when side = 1 then upto / total end) over w as fb
             from (select a, b, value, upto, total, if(period = b, 1, 0) as side
                   from (select lag(period) over (order by period) as a, period as b
                         from (select distinct period from score_points))
                   join score_points on period = a or period = b
                   where a is not null)
             window w as (partition by a, b order by value))
       group by a, b"""
)
ORACLE["bucketed_upsert"] = ORACLE["upsert_latest"]


def _version_snapshot(version: str) -> str:
    """The yearly drift snapshot of one model version."""
    mine = f"(select * from predictions where model_version = '{version}')"
    years = f"select %s(year(scored_at)) from {mine}"
    first, last = (f"year(scored_at) = ({years % f})" for f in ("min", "max"))
    ks = _ks(first, last).replace("from predictions where", f"from {mine} where")
    return f"""
        select max(model_version) as model_version, DATE '2001-08-01' as snapshot_date,
               count(*) as total_scored, round(avg(pd_probability_ens), 6) as avg_pd,
               round(stddev_pop(pd_probability_ens), 6) as std_pd, {_SHARES},
               any_value(ks) as ks_statistic, any_value(p) as ks_pvalue,
               any_value(p) <= 0.05 and any_value(ks) >= 0.05 as drift_detected,
               if(any_value(p) > 0.05 or any_value(ks) < 0.05, 'none',
                  if(any_value(ks) < 0.1, 'minor',
                     if(any_value(ks) < 0.2, 'moderate', 'severe'))) as drift_severity
        from {mine}, (select round(d, 6) as ks, round({_P_VALUE}, 6) as p from ({ks}))
        where {last}"""


ORACLE["monitoring_history"] = sql(
    " union all ".join(_version_snapshot(v) for v in ("v0", "v1", "v2"))
)

# --------------------------------------------------------------------------- landing, audit

FRAGMENTS["landed_loans"] = """
select *, TIMESTAMP '2002-01-01 00:00:00' as _bronze_ingested_at,
       'loan_applications.csv' as _bronze_source_file,
       concat(substr(application_date, 1, 4), '-12-31') as _bronze_execution_date
from bronze_loans
"""
ORACLE["bronze_metadata"] = sql("select * from landed_loans")
ORACLE["bronze_partition_read"] = sql(
    """select application_id, loan_amount_inr, _bronze_execution_date
       from landed_loans where _bronze_execution_date = '1998-12-31'"""
)
_BRONZE_TABLES = {
    "loan_applications": (
        "bronze_loans",
        "application_date",
        "application_id customer_id application_date loan_amount_inr loan_term_months "
        "annual_income_inr employment_type loan_purpose existing_loans credit_score "
        "collateral_value default_flag",
    ),
    "credit_bureau": (
        "bronze_bureau",
        "bureau_pull_date",
        "customer_id bureau_pull_date credit_score total_accounts open_accounts "
        "delinquent_accounts credit_utilisation_pct oldest_account_months hard_inquiries_6m "
        "total_credit_limit_inr total_balance_inr",
    ),
    "transactions": (
        "bronze_txn",
        "transaction_date",
        "transaction_id customer_id transaction_date amount_inr transaction_type "
        "balance_after_inr is_flagged",
    ),
}


def _profile(source: str) -> str:
    table, _, columns = _BRONZE_TABLES[source]
    names = columns.split()
    listed = str(sorted(names)).replace("'", "''")
    return f"""select '{source}' as source_name, count(*) as row_count,
                      {len(names)} as columns, 'string' as customer_id_type,
                      substr(sha256('{listed}|' || count(*)), 1, 16) as row_hash from {table}"""


ORACLE["ingest_profile"] = sql(" union all ".join(_profile(s) for s in _BRONZE_TABLES))


def _runs(source: str) -> str:
    table, day, _ = _BRONZE_TABLES[source]
    return f"""select concat('run-', y, '-12-31') as run_id, '{source}' as source_name,
                      cast(concat(y, '-12-31') as date) as execution_date, 'success' as status,
                      n as row_count,
                      cast(concat(y, '-12-31') as timestamp) + interval 1 minute as ingested_at
               from (select substr({day}, 1, 4) as y, count(*) as n from {table} group by 1)"""


ORACLE["audit_latest"] = sql(" union all ".join(_runs(s) for s in _BRONZE_TABLES))


#: From this year on a source has its new column and no longer its old one.
_CHANGE_YEAR = 1996
_CHANGED_COLUMNS = {
    "loan_applications": ("default_flag", "collateral_value"),
    "credit_bureau": ("hard_inquiries_6m", "oldest_account_months"),
}


def _snapshot(source: str, late: bool) -> str:
    table, day, columns = _BRONZE_TABLES[source]
    gone = _CHANGED_COLUMNS.get(source, ("", ""))[late]
    columns = " ".join(c for c in columns.split() if c != gone)
    years = f"cast(substr({day}, 1, 4) as int) {'>=' if late else '<'} {_CHANGE_YEAR}"

    def entry(c: str) -> str:
        text = f"trim(cast({c} as varchar))"
        whole = f"count(*) filter (where regexp_matches({text}, '^[+-]?\\d+$'))"
        number = (
            f"count(*) filter (where regexp_matches({text}, "
            f"'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'))"
        )
        kind = (
            f"case when {whole} = count(*) then 'int64' when {number} = count({c}) "
            "then 'float64' else 'object' end"
        )
        return f"'\"{c}\": \"' || {kind} || '\"'"

    entries = " || ', ' || ".join(entry(c) for c in sorted(columns.split()))
    return f"""select '{source}' as source_name,
                      cast(concat(substr({day}, 1, 4), '-12-31') as date) as snapshot_date,
                      '{{' || {entries} || '}}' as column_dtypes
               from {table} where {years} group by substr({day}, 1, 4)"""


FRAGMENTS["snapshots"] = (
    "select *, substr(sha256(column_dtypes), 1, 16) as schema_hash from ("
    + " union all ".join(_snapshot(s, late) for s in _BRONZE_TABLES for late in (False, True))
    + ")"
)
ORACLE["schema_snapshot"] = sql("select * from snapshots")
ORACLE["schema_drift"] = sql(
    """select source_name, snapshot_date, schema_hash, previous_hash,
              previous_hash is not null and previous_hash <> schema_hash as changed,
              ifnull(list_aggregate(list_sort(list_filter(json_keys(column_dtypes), lambda c:
                  not list_contains(json_keys(ifnull(was, column_dtypes)), c))), 'string_agg', ','),
                  '') as added,
              ifnull(list_aggregate(list_sort(list_filter(json_keys(ifnull(was, column_dtypes)),
                  lambda c: not list_contains(json_keys(column_dtypes), c))), 'string_agg', ','),
                  '') as removed,
              ifnull(list_aggregate(list_sort(list_filter(json_keys(column_dtypes), lambda c:
                  json_extract_string(column_dtypes, c)
                  <> json_extract_string(ifnull(was, column_dtypes), c))), 'string_agg', ','), '')
                  as retyped
       from (select *, lag(schema_hash) over w as previous_hash, lag(column_dtypes) over w as was
             from snapshots window w as (partition by source_name order by snapshot_date))"""
)

# --------------------------------------------------------------------------- registry

FRAGMENTS["version_auc"] = """
select model_version, sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)) as auc,
       cast(sum(pos) + sum(neg) as bigint) as test_rows
from (select *, coalesce(sum(neg) over (partition by model_version order by score
                    rows between unbounded preceding and 1 preceding), 0)::double as below
      from (select model_version, pd_probability_ens as score,
                   count(*) filter (where default_flag = 1) as pos,
                   count(*) filter (where default_flag = 0) as neg
            from labelled_scores group by 1, 2))
group by model_version
"""
FRAGMENTS["registered"] = """
select model_version, round(auc, 8) as ensemble_auc, test_rows,
       TIMESTAMP '2002-01-01' + to_days(cast(substr(model_version, 2) as integer))
           as registered_at,
       -- a version takes over when it beats every version that was active before it
       auc > coalesce(max(auc) over (order by model_version
                      rows between unbounded preceding and 1 preceding), -1) as took_over
from version_auc
"""
ORACLE["registry_transition"] = sql(
    """select model_version, ensemble_auc, test_rows,
              if(not took_over, 'candidate', if(model_version =
                 (select max(model_version) from registered where took_over),
                 'active', 'retired')) as status, registered_at
       from registered"""
)
ORACLE["model_registry"] = sql(
    """select model_version, ensemble_auc, test_rows,
              if(model_version = 'v0', 'active', if(took_over, 'retired', 'candidate'))
                  as status, registered_at
       from registered"""
)

# --------------------------------------------------------------------------- live scoring, drivers

WEIGHTS = {
    "annual_income_inr": (-0.000001, 300000.0),
    "loan_term_months": (0.002, 48.0),
    "credit_score": (-0.004, 600.0),
    "loan_to_income_ratio": (0.35, 1.5),
    "collateral_coverage_ratio": (-0.01, 5.0),
    "dti_ratio": (0.8, 0.4),
    "delinquency_rate": (0.7, 0.1),
    "hard_inquiries_6m": (0.05, 2.0),
    "bureau_utilisation_pct": (0.6, 0.5),
    "emi_regularity_score": (-0.3, 0.5),
    "credit_stress_score": (0.25, 1.0),
    "total_txns_12m": (-0.01, 5.0),
}


def _part(c: str) -> str:
    w, centre = WEIGHTS[c]
    return f"coalesce(({c}::double - {centre}::double) * {w!r}::double, 0::double)"


_SCORE = " + ".join(["(-0.2::double)", *[_part(c) for c in WEIGHTS]])
_COLUMNS = (
    "application_id, customer_id, pd_probability_rf, pd_probability_lr, pd_probability_ens, "
    "pd_prediction, risk_grade, model_version"
)
ORACLE["score_missing"] = sql(
    f"""select * from (with stored as (
           select * from predictions where scored_at < TIMESTAMP '2000-01-01'
           qualify row_number() over (partition by application_id order by scored_at desc) = 1),
       live as (
           select application_id, customer_id, round(1 / (1 + exp(-({_SCORE}))), 6) as p
           from scoring_frame where application_id not in (select application_id from stored))
       select {_COLUMNS}, 'cache' as source from stored
       union all
       select application_id, customer_id, p, p, round(p, 6), if(p >= 0.5, 1, 0),
              if(p < 0.05, 'A', if(p < 0.15, 'B', if(p < 0.3, 'C', if(p < 0.5, 'D', 'E')))),
              'live', 'live_inference'
       from (select *  replace (round(0.7::double * p + 0.3::double * p, 6) as p) from live))"""
)
FRAGMENTS["driver_cells"] = " union all ".join(
    f"select application_id, customer_id, {i} as place, '{c}' as feature_name, "
    f"{c}::double as v, {_part(c)} as part from scoring_frame"
    for i, c in enumerate(WEIGHTS)
)


def _drivers(digits: int, down: str, smallest: str) -> str:
    return f"""
    select application_id, customer_id, cast(place as integer) as rank, feature_name,
           cast(printf('%.4f', v) as double) as feature_value,
           cast(printf('%.{digits}f', part) as double) as shap_value,
           if(part > 0, 'increases_risk', '{down}') as direction,
           replace(feature_name, '_', ' ') as label
    from (select * replace (row_number() over (partition by application_id
                                order by abs(part) desc, place) as place)
          from driver_cells where abs(part) >= {smallest})
    where place <= 10"""


FRAGMENTS["top_drivers"] = _drivers(6, "decreases_risk", "0")
ORACLE["linear_drivers"] = sql("select * from top_drivers")
ORACLE["driver_explanation"] = sql(_drivers(5, "reduces_risk", "0.000001"))
ORACLE["driver_narrative"] = sql(
    """select application_id, concat('The primary factors increasing default risk are: ',
              coalesce(array_to_string(list(t order by rank) filter (where up)[1:3], ', '),
                       'no dominant risk factors'),
              '. Protective factors include: ',
              coalesce(array_to_string(list(t order by rank) filter (where not up)[1:2], ', '),
                       'no significant protective factors'), '.') as narrative
       from (select *, direction = 'increases_risk' as up,
                    label || ' (' || cast(feature_value as varchar) || ')' as t from top_drivers)
       group by application_id"""
)
ORACLE["attribution_sums"] = sql(
    """select application_id, method, true as adds_up
       from scoring_frame, (select unnest(['shapley', 'path']) as method)"""
)
FRAGMENTS["driver_texts"] = """
select application_id, concat('Top risk drivers for ', application_id, ':', chr(10),
       string_agg(concat('  ', rank, '. ', feature_name, ' (SHAP=', printf('%+.4f', shap_value),
           ') → ', if(direction = 'increases_risk', 'INCREASES default risk',
                      'DECREASES default risk (protective factor)')),
           chr(10) order by rank)) as driver_text
from top_drivers where rank <= 5 group by application_id
"""
ORACLE["driver_text"] = sql("select * from driver_texts")

# --------------------------------------------------------------------------- landing

ORACLE["landed_types"] = """
select * from (values
  ('customer_id', 'string', 3::integer, '2001-07-01', '2001-07-03', 'string'),
  ('credit_score', 'bigint', 1::integer, '2001-07-01', '2001-07-01', 'string'),
  ('credit_score', 'string', 1::integer, '2001-07-02', '2001-07-02', 'string'),
  ('credit_score', 'double', 1::integer, '2001-07-03', '2001-07-03', 'string'),
  ('hard_inquiries_6m', 'string', 2::integer, '2001-07-02', '2001-07-03', 'string'))
  t(column_name, type, days, first_day, last_day, read_as)"""
ORACLE["retyped_history"] = sql(
    """select if(score is null, null, third = 2) as with_decimals,
              third = 0 or inquiries is null as without_inquiries,
              sum(score + if(third = 2, 0.5, 0)) as sum_of_scores
       from (select ascii(right(customer_id, 1)) % 3 as third, cast(credit_score as double) as score,
                    hard_inquiries_6m as inquiries
             from bronze_bureau where customer_id is not null)
       group by 1, 2"""
)

# --------------------------------------------------------------------------- retrieval

_TRIM = "regexp_replace(%s, '^\\s+|\\s+$', '', 'g')"
FRAGMENTS["chunks"] = f"""
with recursive paragraphs as (
    select doc_id, p, {_TRIM % "body"} as body from (
        select doc_id, unnest(string_split(text, chr(10) || chr(10))) as body,
               generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as p
        from documents)
), lines as (
    select doc_id, p, row_number() over (partition by doc_id, p order by i) as i, line from (
        select doc_id, p, {_TRIM % "piece"} as line, i from (
            select doc_id, p, unnest(string_split(body, chr(10))) as piece,
                   generate_subscripts(string_split(body, chr(10)), 1) as i
            from paragraphs where length(body) > 800))
    where line <> ''
), packed as (
    select doc_id, p, i, line as current, cast(null as varchar) as done from lines where i = 1
    union all
    select l.doc_id, l.p, l.i,
           if(length(k.current) + length(l.line) + 1 <= 800,
              k.current || chr(10) || l.line, l.line),
           if(length(k.current) + length(l.line) + 1 <= 800, null, k.current)
    from packed k join lines l on l.doc_id = k.doc_id and l.p = k.p and l.i = k.i + 1
), pieces as (
    select doc_id, p, 0::bigint as i, body as text from paragraphs
    where length(body) between 1 and 800
    union all select doc_id, p, i, done from packed where done is not null
    union all select doc_id, p, i + 1, current from packed
    qualify row_number() over (partition by doc_id, p order by i desc) = 1
)
select cast(doc_id as varchar) as source, text,
       cast(row_number() over (partition by doc_id order by p, i) - 1 as integer) as chunk_index,
       cast(count(*) over (partition by doc_id) as integer) as total_chunks
from pieces where length(text) > 30
"""
ORACLE["chunk_documents"] = sql(
    """select substr(sha256(concat(source, '::', chunk_index, '::', substr(text, 1, 50))), 1, 16)
                  as id, text, source, source || '.txt' as filename,
              coalesce(nullif(lower(trim(regexp_extract(text,
                  'SECTION\\s+\\d+[:\\s]+([^\\n]+)', 1))), ''), 'general') as section,
              chunk_index, cast(length(text) as integer) as char_count, total_chunks
       from chunks"""
)
ORACLE["chunk_stats"] = sql(
    """select source, count(*) as chunks, cast(sum(length(text)) as bigint) as chars,
              cast(min(length(text)) as integer) as shortest,
              cast(max(length(text)) as integer) as longest
       from chunks group by source"""
)
FRAGMENTS["topic_hits"] = """
with cells as (
    select label, unnest(embedding)::double as x,
           generate_subscripts(embedding, 1) as pos from embeddings
), topics as (
    select label, list(m order by pos) as centre
    from (select label, pos, avg(x) as m from cells group by label, pos) group by label
), pairs as (
    select t.label as query_id, e.vec_id,
           1 - list_cosine_similarity(t.centre, e.embedding::double[]) as distance
    from topics t, embeddings e
)
select query_id, cast(place as integer) as rank, vec_id, distance
from (select *, row_number() over (partition by query_id
                    order by round(distance, 6), vec_id) as place from pairs)
where place <= 5
"""
ORACLE["vector_topk"] = sql(
    "select query_id, rank, vec_id, round(distance, 4) as distance from topic_hits"
)
ORACLE["vector_search"] = sql(
    """select query_id, cast(place as integer) as rank, vec_id, round(distance, 4) as distance
       from (select *, row_number() over (partition by query_id
                         order by round(distance, 6), vec_id) as place
             from (select q.vec_id as query_id, e.vec_id,
                          1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[])
                              as distance
                   from embeddings q, embeddings e where q.vec_id % 20 = 0))
       where place <= 10"""
)
FRAGMENTS["chunk_ids"] = """
select substr(sha256(concat(source, '::', chunk_index, '::', substr(text, 1, 50))), 1, 16) as id, *
from chunks
"""
FRAGMENTS["chunk_terms"] = r"""
select id, source, term, count(*) as tf
from (select id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term
      from chunk_ids) group by id, source, term
"""
FRAGMENTS["rarity"] = """
select term, count(*) as n from chunk_terms group by term
"""
FRAGMENTS["chunk_weights"] = """
select *, sqrt(sum(w * w) over (partition by id)) as length
from (select id, term, tf * ln(((select count(*) from chunks) + 1.0::double) / (n + 1.0)) as w
      from chunk_terms join rarity using (term))
"""
FRAGMENTS["asked"] = """
select concat(conv_id, '-', turn) as query_id, text from conversations where role = 'user'
"""
FRAGMENTS["asked_weights"] = r"""
select *, sqrt(sum(w * w) over (partition by query_id)) as length
from (select query_id, term,
             tf * ln(((select count(*) from chunks) + 1.0::double) / (coalesce(n, 0) + 1.0)) as w
      from (select query_id, term, count(*) as tf
            from (select query_id,
                         unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term
                  from asked) group by query_id, term)
      left join rarity using (term))
"""
FRAGMENTS["question_hits"] = """
select query_id, cast(place as integer) as rank, id, distance
from (select *, row_number() over (partition by query_id order by round(distance, 6), id) as place
      from (select a.query_id, c.id, 1 - coalesce(s, 0) as distance
            from asked a cross join chunk_ids c
            left join (select q.query_id, d.id, sum(q.w / q.length * (d.w / d.length)) as s
                       from asked_weights q join chunk_weights d using (term)
                       where q.length > 0 and d.length > 0 group by q.query_id, d.id) p
                on p.query_id = a.query_id and p.id = c.id))
where place <= 5
"""
ORACLE["tfidf_topk"] = sql(
    "select query_id, rank, id, round(distance, 4) as distance from question_hits"
)
ORACLE["term_frequencies"] = sql(
    """select chunks, count(*) as terms
       from (select term, count(*) as chunks from chunk_terms
             where cast(source as bigint) % 10 <> 0 group by term)
       group by chunks"""
)
FRAGMENTS["cited"] = """
select h.query_id, h.rank, c.source, c.source || '.txt' as filename,
       coalesce(nullif(lower(trim(regexp_extract(c.text,
           'SECTION\\s+\\d+[:\\s]+([^\\n]+)', 1))), ''), 'general') as section,
       c.chunk_index, c.text, round(h.distance, 4) as distance
from question_hits h join chunk_ids c using (id)
"""
ORACLE["cited_sources"] = sql(
    """select query_id, rank, source, filename, section, chunk_index,
              substr(text, 1, 200) as excerpt, distance
       from cited"""
)
FRAGMENTS["contexts"] = """
select query_id, count(*) as n_sources,
       string_agg(concat('[Source ', rank, ': ', source, ' — ', section, ']', chr(10), text),
                  chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)
           as policy_context
from cited group by query_id
"""
ORACLE["cited_context"] = sql("select * from contexts")
_INSTRUCTIONS = (
    "You assist a retail credit officer. Answer from the numbered policy passages and cite "
    "them as [Source N]. Use the customer''s default probability and risk drivers when they "
    "are given. If the passages do not settle the question, say so; do not invent thresholds. "
    "Give the answer, its policy basis and a recommendation."
)
ORACLE["analyst_prompts"] = sql(
    f"""select question_id, id as application_id,
              concat_ws(chr(10) || chr(10), '{_INSTRUCTIONS}',
                 concat('RELEVANT POLICY CONTEXT:', chr(10), chr(10), ifnull(policy_context, '')),
                 chr(10) || 'CUSTOMER RISK PROFILE:' || chr(10)
                     || '  Application ID : ' || p.application_id || chr(10)
                     || '  Customer ID    : ' || p.customer_id || chr(10)
                     || '  PD Probability : ' || printf('%.2f%%', pd_probability_ens * 100)
                     || chr(10)
                     || '  Risk Grade     : ' || risk_grade || '  (A=lowest, E=highest)' || chr(10)
                     || '  Model Version  : ' || model_version,
                 if(p.application_id is null, null,
                    chr(10) || 'SHAP RISK DRIVERS:' || chr(10) || driver_text),
                 chr(10) || 'CREDIT ANALYST QUESTION:' || chr(10) || q.text || chr(10) || chr(10)
                     || 'Provide a thorough, policy-grounded answer with source citations.')
              as prompt
       from (select *, concat(conv_id, '-', turn) as question_id, concat('APP', lpad(cast(conv_id as varchar), 12, '0')) as id
             from conversations where role = 'user') q
       left join latest p on p.application_id = q.id
       left join driver_texts t on t.application_id = q.id
       left join contexts c on c.query_id = q.question_id"""
)
ORACLE["assessment_questions"] = sql(
    """select application_id as question_id,
              concat('Provide a complete credit risk assessment for application ', application_id,
                  '. Explain the key risk factors, cite relevant policy thresholds, and give a ',
                  'clear approve/decline recommendation with rationale.') as question,
              application_id as query_id, application_id
       from latest"""
)
