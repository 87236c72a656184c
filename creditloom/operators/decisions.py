"""Approve, refer or decline: score context plus policy rules, for any number of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.text import fixed, percent
from creditloom.operators.latest import latest_per_key

# Policy thresholds, and the wording of reasons and policy references.
DECLINE_GRADES = ["D", "E"]
APPROVE_GRADES = ["A", "B"]
APPROVE_DTI_TIERS = ["low", "moderate"]
DECLINE_DTI_TIER = "high"
MIN_CREDIT_SCORE = 550
TEXT_GRADE_DECLINE = (
    "Risk grade %s (PD %s) exceeds acceptable default probability threshold for approval."
)
TEXT_DTI_DECLINE = (
    "DTI ratio %s classified as high risk (>=0.50), exceeding RBI prudential threshold."
)
TEXT_SCORE_DECLINE = (
    "Credit score %s falls below the minimum threshold of 550 for any product line."
)
TEXT_GRADE_APPROVE = "Risk grade %s (PD %s) falls within standard approval threshold."
TEXT_DTI_APPROVE = "DTI ratio %s classified as %s risk, within approval bounds."
TEXT_SCORE_APPROVE = "Credit score %s meets minimum product requirements."
TEXT_REFER = (
    "Risk grade %s (PD %s) combined with DTI tier '%s' requires senior credit officer review."
)
REF_GRADE_DECLINE = "Basel III PD Risk Grade D/E — decline recommended"
REF_DTI_DECLINE = "RBI DTI threshold — Section 4, high risk >= 50%"
REF_SCORE_DECLINE = "RBI Section 5 — minimum credit score requirement"
REF_GRADE_APPROVE = "Basel III PD Risk Grade A/B — standard approval"
REF_DTI_APPROVE = "RBI DTI threshold — low/moderate risk band"
REF_REFER = "Basel III PD Risk Grade C — enhanced monitoring"

# Columns of an application that a decision shows.
CONTEXT_COLUMNS = [
    "loan_amount_inr",
    "annual_income_inr",
    "employment_type",
    "loan_purpose",
    "credit_score",
    "loan_to_income_ratio",
    "dti_ratio",
    "dti_risk_tier",
    "credit_risk_tier",
]


def latest_prediction(predictions: DataFrame, version: str | None = None) -> DataFrame:
    """Newest score of every application, optionally of one model version only."""
    if version is not None:
        predictions = predictions.where(F.col("model_version") == version)
    return latest_per_key(predictions, ["application_id"], [F.col("scored_at").desc()])


def with_loan_context(latest: DataFrame, dti: DataFrame) -> DataFrame:
    """Add loan and debt columns; both sides have one row per application."""
    return latest.join(dti.select("application_id", *CONTEXT_COLUMNS), "application_id", "left")


def _case(branches: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first branch whose condition holds."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def decide(scored: DataFrame) -> DataFrame:
    """Add decision, confidence, reasoning and policy_refs.

    Needs risk_grade, pd_probability_ens, dti_ratio, dti_risk_tier and credit_score.
    Conditions are tried in order and the first match decides.
    """
    grade = F.upper(F.coalesce("risk_grade", F.lit("")))
    tier = F.lower(F.coalesce("dti_risk_tier", F.lit("unknown")))
    pd_text = percent(F.col("pd_probability_ens"))
    dti, score = F.col("dti_ratio"), F.col("credit_score")
    dti_text, score_text = fixed(dti, 2), fixed(score, 0)

    def say(template: str, *values: Column) -> Column:
        return F.format_string(template, *values)

    def listed(*texts) -> Column:
        return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])

    bad_grade = grade.isin(DECLINE_GRADES)
    bad_dti = tier == DECLINE_DTI_TIER
    bad_score = F.coalesce(score < MIN_CREDIT_SCORE, F.lit(False))
    good = grade.isin(APPROVE_GRADES) & tier.isin(APPROVE_DTI_TIERS)

    approve_reasons = F.array_compact(
        listed(
            say(TEXT_GRADE_APPROVE, grade, pd_text),
            F.when(dti.isNotNull(), say(TEXT_DTI_APPROVE, dti_text, tier)),
            F.when(score.isNotNull(), say(TEXT_SCORE_APPROVE, score_text)),
        )
    )
    reasoning = _case(
        [
            (bad_grade, listed(say(TEXT_GRADE_DECLINE, grade, pd_text))),
            (bad_dti, listed(say(TEXT_DTI_DECLINE, dti_text))),
            (bad_score, listed(say(TEXT_SCORE_DECLINE, score_text))),
            (good, approve_reasons),
        ],
        listed(say(TEXT_REFER, grade, pd_text, tier)),
    )
    refs = _case(
        [
            (bad_grade, listed(REF_GRADE_DECLINE)),
            (bad_dti, listed(REF_DTI_DECLINE)),
            (bad_score, listed(REF_SCORE_DECLINE)),
            (good, listed(REF_GRADE_APPROVE, REF_DTI_APPROVE)),
        ],
        listed(REF_REFER),
    )
    decision = _case(
        [(bad_grade | bad_dti | bad_score, F.lit("DECLINE")), (good, F.lit("APPROVE"))],
        F.lit("REFER"),
    )
    sure = F.col("decision").isin("APPROVE", "DECLINE") & (F.size("reasoning") >= 2)
    return (
        scored.withColumns({"decision": decision, "reasoning": reasoning, "policy_refs": refs})
        .withColumn("confidence", F.when(sure, "high").otherwise("medium"))
    )


def decide_applications(predictions: DataFrame, dti: DataFrame) -> DataFrame:
    """Decision for every scored application."""
    return decide(with_loan_context(latest_prediction(predictions), dti))


def decision_mix(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision", "risk_grade").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pd_probability_ens"), 6).alias("avg_pd")
    )


# Columns of a batch result file, in order.
BATCH_COLUMNS = [
    "application_id",
    "customer_id",
    "pd_probability_rf",
    "pd_probability_lr",
    "pd_probability_ens",
    "risk_grade",
    "decision",
    "confidence",
    "reasoning",
    "error",
]
REASON_SEPARATOR = " | "


def score_ids(ids: DataFrame, decided: DataFrame, id_column: str = "application_id") -> DataFrame:
    """One result row per requested id; an unknown id gives a row with an error text.

    Ids are trimmed and upper-cased, blank ones are skipped, repeated ones are answered each
    time.  ``decided`` has one row per application; pass it as a written table so that an id
    requested very often can be split.
    """
    requested = ids.select(F.upper(F.trim(id_column)).alias("application_id")).where(
        F.col("application_id") != ""
    )
    known = decided.withColumn("_known", F.lit(True))
    joined = requested.join(known, "application_id", "left")
    found = F.col("_known").isNotNull()
    values = {
        "reasoning": F.concat_ws(REASON_SEPARATOR, "reasoning"),
        "error": F.when(found, "").otherwise(
            F.concat(F.col("application_id"), F.lit(" not found"))
        ),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in BATCH_COLUMNS])
