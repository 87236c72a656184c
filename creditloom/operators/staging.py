"""Staging models: raw text rows in, typed and deduplicated rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import bands
from creditloom.functions.numbers import clamp, ratio
from creditloom.operators.latest import latest_per_key


def _typed(names: list[str], spark_type: str) -> dict[str, Column]:
    return {n: F.col(n).cast(spark_type) for n in names}


def stg_loans(bronze: DataFrame) -> DataFrame:
    """One row per application: typed, rejected rows dropped, latest ingest kept.

    Rows without keys or with no positive income are rejected before anything else is
    computed.  Of several rows for one application the latest ingest wins, then the latest
    application date.
    """
    accepted = bronze.where(
        F.col("application_id").isNotNull()
        & F.col("customer_id").isNotNull()
        & (F.col("annual_income_inr").cast("bigint") > 0)
    )
    if "_bronze_ingested_at" not in accepted.columns:
        accepted = accepted.withColumn("_bronze_ingested_at", F.lit(None).cast("timestamp"))
    typed = accepted.select(
        F.trim("application_id").alias("application_id"),
        F.trim("customer_id").alias("customer_id"),
        F.col("application_date").cast("date").alias("application_date"),
        *[
            c.alias(n)
            for n, c in {
                **_typed(["loan_amount_inr", "annual_income_inr"], "bigint"),
                **_typed(["loan_term_months", "existing_loans"], "int"),
                "collateral_value_inr": F.col("collateral_value").cast("bigint"),
                **_typed(["credit_score"], "int"),
            }.items()
        ],
        F.lower(F.trim("employment_type")).alias("employment_type"),
        F.lower(F.trim("loan_purpose")).alias("loan_purpose"),
        F.col("default_flag").cast("int").alias("default_flag"),
        "_bronze_ingested_at",
    )
    newest = latest_per_key(
        typed,
        ["application_id"],
        [F.col("_bronze_ingested_at").desc_nulls_last(), F.col("application_date").desc()],
    ).drop("_bronze_ingested_at")
    amount, income = F.col("loan_amount_inr"), F.col("annual_income_inr")
    return newest.withColumns(
        {
            "loan_to_income_ratio": ratio(amount, income),
            "collateral_coverage_ratio": ratio(F.col("collateral_value_inr"), amount),
            "credit_risk_tier": bands.credit_tier(F.col("credit_score")),
        }
    )


def stg_credit(bronze: DataFrame) -> DataFrame:
    """One row per customer: the most recent bureau pull (an undated pull counts as newest)."""
    typed = bronze.where(F.col("customer_id").isNotNull()).select(
        F.trim("customer_id").alias("customer_id"),
        F.col("bureau_pull_date").cast("date").alias("bureau_pull_date"),
        *[
            c.alias(n)
            for n, c in {
                **_typed(
                    [
                        "credit_score",
                        "total_accounts",
                        "open_accounts",
                        "delinquent_accounts",
                        "hard_inquiries_6m",
                        "oldest_account_months",
                    ],
                    "int",
                ),
                **_typed(["total_credit_limit_inr", "total_balance_inr"], "bigint"),
                "_raw_utilisation": F.col("credit_utilisation_pct").cast("double"),
            }.items()
        ],
    )
    newest = latest_per_key(
        typed, ["customer_id"], [F.col("bureau_pull_date").desc_nulls_first()]
    )
    raw, accounts = F.col("_raw_utilisation"), F.col("total_accounts")
    headroom = F.col("total_credit_limit_inr") - F.col("total_balance_inr")
    return newest.withColumns(
        {
            "credit_utilisation_pct": clamp(raw, 0.0, 1.0),
            "available_credit_inr": F.greatest(F.lit(0).cast("bigint"), headroom),
            "utilisation_band": bands.utilisation_band(raw),
            "high_inquiry_flag": bands.flag(
                F.col("hard_inquiries_6m") >= bands.HIGH_INQUIRY_COUNT
            ),
            "delinquency_rate": F.coalesce(
                ratio(F.col("delinquent_accounts"), accounts),
                F.when(accounts > 0, F.lit(None)).otherwise(F.lit(0.0)),
            ),
            "credit_age_band": bands.credit_age_band(F.col("oldest_account_months")),
        }
    ).drop("_raw_utilisation")
