"""Declarative column checks: a suite of checks in, one result row per check out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """One check on one column.  ``kind``: not_null, unique, accepted_values, accepted_range."""

    table: str
    column: str
    kind: str
    values: tuple = ()
    low: float | None = None
    high: float | None = None


def _checks(table: str, rules: Mapping[str, Sequence]) -> list[Check]:
    out = []
    for column, tests in rules.items():
        for test in tests:
            if isinstance(test, str):
                out.append(Check(table, column, test))
            elif isinstance(test, list):
                out.append(Check(table, column, "accepted_values", tuple(map(str, test))))
            else:
                out.append(Check(table, column, "accepted_range", low=test[0], high=test[1]))
    return out


# The column checks.  A string names a check, a list holds accepted values, a
# tuple an accepted range.
FLAG_VALUES = [0, 1]
SILVER_CHECKS = (
    _checks(
        "stg_loans",
        {
            "application_id": ["unique", "not_null"],
            "customer_id": ["not_null"],
            "application_date": ["not_null"],
            "loan_amount_inr": ["not_null"],
            "annual_income_inr": ["not_null"],
            "credit_risk_tier": [["low", "medium", "high", "very_high"]],
            "employment_type": [["salaried", "self_employed", "contract", "unemployed"]],
            "default_flag": [FLAG_VALUES],
            "silver_processed_at": ["not_null"],
        },
    )
    + _checks(
        "stg_credit",
        {
            "customer_id": ["unique", "not_null"],
            "credit_utilisation_pct": ["not_null"],
            "utilisation_band": [["low", "medium", "high", "maxed_out"]],
            "high_inquiry_flag": [FLAG_VALUES],
            "credit_age_band": [["new", "developing", "established", "mature"]],
            "silver_processed_at": ["not_null"],
        },
    )
    + _checks(
        "feat_dti_ratio",
        {
            "application_id": ["unique", "not_null"],
            "customer_id": ["not_null"],
            "dti_risk_tier": [["low", "moderate", "elevated", "high", "unknown"]],
            "combined_risk_flag": [FLAG_VALUES],
            "feature_computed_at": ["not_null"],
        },
    )
    + _checks(
        "feat_credit_util",
        {
            "customer_id": ["unique", "not_null"],
            "utilisation_change_flag": [FLAG_VALUES],
            "balance_trend_flag": [FLAG_VALUES],
            "feature_computed_at": ["not_null"],
        },
    )
)
BRONZE_CHECKS = (
    _checks(
        "loan_applications",
        {
            "application_id": ["unique", "not_null"],
            "customer_id": ["not_null"],
            "loan_amount_inr": ["not_null"],
            "annual_income_inr": ["not_null"],
            "credit_score": ["not_null", (300, 900)],
            "default_flag": [FLAG_VALUES],
        },
    )
    + _checks(
        "credit_bureau",
        {
            "customer_id": ["not_null"],
            "credit_utilisation_pct": [(0, 1)],
            "credit_score": ["not_null"],
        },
    )
    + _checks(
        "transactions",
        {
            "transaction_id": ["unique", "not_null"],
            "customer_id": ["not_null"],
            "amount_inr": ["not_null"],
        },
    )
)
MACRO_CHECKS = _checks("macro_indicators", {"date": ["unique", "not_null"]})


def _violates(check: Check) -> Column:
    """Row condition of a check that looks at one row at a time; NULL passes value checks."""
    value = F.col(check.column)
    if check.kind == "not_null":
        return value.isNull()
    if check.kind == "accepted_values":
        return ~value.cast("string").isin(*check.values)
    if check.kind == "accepted_range":
        return ~value.cast("double").between(check.low, check.high)
    raise ValueError(f"unknown check kind {check.kind!r}")


def _named(check: Check) -> list[Column]:
    return [
        F.lit(check.table).alias("table_name"),
        F.lit(check.column).alias("column_name"),
        F.lit(check.kind).alias("check_kind"),
    ]


def _repeated(df: DataFrame, check: Check) -> DataFrame:
    counted = df.where(F.col(check.column).isNotNull()).groupBy(check.column)
    repeated = counted.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("failures")).select(*_named(check), "failures")


def check_table(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Run all checks of one table in one pass: row checks are counted on the way to the rows per
    unique key, so a table that is a join is joined once.  Further unique keys take a pass each.

    The failure count is violating rows, for ``unique`` the number of repeated values.
    """
    by_row = [c for c in checks if c.kind != "unique"]
    unique = [c for c in checks if c.kind == "unique"]
    counts = {f"_f{i}": F.count_if(_violates(c)) for i, c in enumerate(by_row)}
    named = [c.alias(name) for name, c in counts.items()]
    if unique and by_row:
        key = F.col(unique[0].column)
        groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *named)
        totals = groups.agg(
            *[F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in counts],
            F.count_if(key.isNotNull() & (F.col("_n") > 1)).alias("_repeated"),
        )
        found = {**dict(zip(counts, by_row)), "_repeated": unique.pop(0)}
    elif by_row:
        totals, found = df.agg(*named), dict(zip(counts, by_row))
    else:
        found = {}
    results = [F.struct(*_named(c), F.col(name).alias("failures")) for name, c in found.items()]
    parts = [totals.select(F.inline(F.array(*results)))] if found else []
    return reduce(DataFrame.unionByName, parts + [_repeated(df, c) for c in unique])


def run_suite(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One result row (table, column, kind, failures, status) per check."""
    parts = [
        check_table(df, [c for c in checks if c.table == name])
        for name, df in tables.items()
        if any(c.table == name for c in checks)
    ]
    status = F.when(F.col("failures") == 0, "pass").otherwise("fail")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)


def failing_values(df: DataFrame, check: Check) -> DataFrame:
    """The offending values of one check with their row counts."""
    if check.kind == "unique":
        counted = df.where(F.col(check.column).isNotNull()).groupBy(check.column)
        return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    bad = df.where(_violates(check))
    return bad.groupBy(check.column).agg(F.count(F.lit(1)).alias("n"))


def run_summary(results: DataFrame, models_run: int) -> DataFrame:
    """One row: models run, checks passed and failed, overall status."""
    failed = F.count_if(F.col("status") == "fail")
    return results.agg(
        F.lit(models_run).alias("models_run"),
        F.count_if(F.col("status") == "pass").alias("tests_passed"),
        failed.alias("tests_failed"),
        F.when(failed == 0, "success").otherwise("partial").alias("status"),
    )


class QualityError(RuntimeError):
    """Raised when a suite that must pass has failing checks."""


def require_pass(results: DataFrame) -> None:
    """Stop the pipeline when a check failed; results have one row per check."""
    failed = results.where(F.col("status") == "fail").collect()
    if failed:
        names = ", ".join(f"{r.table_name}.{r.column_name}:{r.check_kind}" for r in failed)
        raise QualityError(f"failed checks: {names}")
