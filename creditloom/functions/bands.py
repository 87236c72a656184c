"""Banding rules: numeric column in, category column out.

Each rule is a ladder of (upper bound, label) steps, tried in order, plus the label that
catches everything else, including NULL unless the rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and labels of the credit policy.
CREDIT_TIERS = [(750, "low"), (600, "medium"), (450, "high")]
CREDIT_TIER_ELSE = "very_high"
UTILISATION_BANDS = [(0.30, "low"), (0.60, "medium"), (0.90, "high")]
UTILISATION_ELSE = "maxed_out"
CREDIT_AGE_BANDS = [(12, "new"), (36, "developing"), (84, "established")]
CREDIT_AGE_ELSE = "mature"
DTI_TIERS = [(0.36, "low"), (0.43, "moderate"), (0.50, "elevated")]
DTI_ELSE = "high"
DTI_MISSING = "unknown"
RISK_GRADES = [(0.05, "A"), (0.15, "B"), (0.30, "C"), (0.50, "D")]
RISK_GRADE_ELSE = "E"
PD_LABELS = [(0.70, "VERY HIGH"), (0.50, "HIGH"), (0.30, "MEDIUM")]
PD_LABEL_ELSE = "LOW"
HIGH_INQUIRY_COUNT = 3
DRIFT_P_VALUE = 0.05
DRIFT_STEPS = [(0.05, "none"), (0.10, "minor"), (0.20, "moderate")]
DRIFT_ELSE = "severe"
ALL_GRADES = ["A", "B", "C", "D", "E"]


def _below(value: Column, steps: list, otherwise: str) -> Column:
    """Label of the first step whose bound lies above the value."""
    return F.coalesce(
        *[F.when(value < bound, F.lit(label)) for bound, label in steps],
        F.lit(otherwise),
    )


def _at_least(value: Column, steps: list, otherwise: str) -> Column:
    """Label of the first step whose bound the value reaches."""
    return F.coalesce(
        *[F.when(value >= bound, F.lit(label)) for bound, label in steps],
        F.lit(otherwise),
    )


def credit_tier(score: Column) -> Column:
    return _at_least(score, CREDIT_TIERS, CREDIT_TIER_ELSE)


def utilisation_band(raw_utilisation: Column) -> Column:
    """Banded on the raw value; a missing value falls through to the last band."""
    return _below(raw_utilisation, UTILISATION_BANDS, UTILISATION_ELSE)


def credit_age_band(months: Column) -> Column:
    return _below(months, CREDIT_AGE_BANDS, CREDIT_AGE_ELSE)


def dti_tier(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit(DTI_MISSING)).otherwise(
        _below(ratio, DTI_TIERS, DTI_ELSE)
    )


def risk_grade(pd: Column) -> Column:
    return _below(pd, RISK_GRADES, RISK_GRADE_ELSE)


def pd_label(pd: Column) -> Column:
    return _at_least(pd, PD_LABELS, PD_LABEL_ELSE)


def drift_severity(statistic: Column, p_value: Column) -> Column:
    return F.when(p_value > DRIFT_P_VALUE, F.lit(DRIFT_STEPS[0][1])).otherwise(
        _below(statistic, DRIFT_STEPS, DRIFT_ELSE)
    )


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)
