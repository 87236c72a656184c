"""Feature models: debt-to-income per application, credit use and behaviour per customer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import bands
from creditloom.functions.numbers import cents, ratio

# Window lengths, repayment assumption and stress thresholds.
WINDOW_MONTHS = 12
RECENT_MONTHS = 3
BUREAU_REPAYMENT_MONTHS = 60
HIGH_DTI = 0.50
UTILISATION_GAP = 0.15
LOW_EMI_REGULARITY = 0.5
HIGH_FLAGGED_RATE = 0.05
SPEND_TYPES = ["debit", "atm_withdrawal", "pos"]
EMI_TYPE = "emi_payment"

# Default for every column that comes from the bureau side of the join: name, source, default.
BUREAU_DEFAULTS = [
    ("bureau_total_balance_inr", "total_balance_inr", 0),
    ("bureau_credit_limit_inr", "total_credit_limit_inr", 0),
    ("bureau_utilisation_pct", "credit_utilisation_pct", 0.0),
    ("delinquent_accounts", "delinquent_accounts", 0),
    ("hard_inquiries_6m", "hard_inquiries_6m", 0),
    ("delinquency_rate", "delinquency_rate", 0.0),
    ("high_inquiry_flag", "high_inquiry_flag", 0),
    ("utilisation_band", "utilisation_band", "unknown"),
]

TXN_DEFAULTS = [
    "avg_monthly_spend_inr",
    "spend_volatility_inr",
    "peak_monthly_spend_inr",
    "emi_payment_count_12m",
    "total_emi_paid_inr_12m",
    "emi_regularity_score",
    "avg_balance_recent_3m",
    "avg_balance_earlier_9m",
    "total_flagged_txns",
    "total_txns_12m",
    "active_months_count",
]


def join_bureau(loans: DataFrame, credit: DataFrame) -> DataFrame:
    """Loans with the bureau signals of their customer, defaulted where there is no record.

    ``credit`` has one row per customer while a customer may have any number of loans, so the
    hot side is ``loans``.  Pass ``credit`` as a written table: adaptive execution then splits
    the partition of a hot customer.
    """
    bureau = credit.select(
        "customer_id",
        F.lit(True).alias("_has_bureau"),
        *[F.col(src).alias(f"_b_{name}") for name, src, _ in BUREAU_DEFAULTS],
    )
    joined = loans.join(bureau, "customer_id", "left")
    return joined.select(
        "application_id",
        "customer_id",
        "application_date",
        "annual_income_inr",
        "loan_amount_inr",
        "loan_term_months",
        "existing_loans",
        "employment_type",
        "loan_purpose",
        "credit_score",
        "loan_to_income_ratio",
        "collateral_coverage_ratio",
        "credit_risk_tier",
        "default_flag",
        *[
            F.coalesce(f"_b_{name}", F.lit(default)).alias(name)
            for name, _, default in BUREAU_DEFAULTS
        ],
        bands.flag(F.col("_has_bureau").isNull()).alias("no_bureau_record_flag"),
    )


def feat_dti_ratio(loans: DataFrame, credit: DataFrame) -> DataFrame:
    """Monthly debt burden against monthly income for each application.

    The ratio is built from the already rounded monthly amounts.
    """

    def monthly(amount: str, months: Column) -> Column:
        return F.round(F.col(amount).cast("double") / months, 2)

    amounts = join_bureau(loans, credit).withColumns(
        {
            "monthly_income_inr": monthly("annual_income_inr", F.lit(12)),
            "estimated_monthly_emi_inr": ratio(
                F.col("loan_amount_inr"), F.col("loan_term_months"), 2
            ),
            "bureau_monthly_burden_inr": monthly(
                "bureau_total_balance_inr", F.lit(BUREAU_REPAYMENT_MONTHS)
            ),
        }
    )
    emi = F.coalesce("estimated_monthly_emi_inr", F.lit(0.0))
    burden = F.coalesce("bureau_monthly_burden_inr", F.lit(0.0))
    # two amounts with two decimals have a sum with two decimals
    debt = amounts.withColumn("total_monthly_debt_inr", F.round(emi + burden, 2))
    rated = debt.withColumn(
        "dti_ratio",
        ratio(cents(F.col("total_monthly_debt_inr")), cents(F.col("monthly_income_inr"))),
    )
    return rated.withColumns(
        {
            "dti_risk_tier": bands.dti_tier(F.col("dti_ratio")),
            "combined_risk_flag": bands.flag(
                (F.col("dti_ratio") >= HIGH_DTI) & (F.col("high_inquiry_flag") == 1)
            ),
        }
    )


def recent_transactions(bronze_txn: DataFrame, as_of: dt.date) -> DataFrame:
    """Typed transactions of the twelve months that end on ``as_of``."""
    day = F.col("transaction_date").cast("date")
    end = F.lit(as_of).cast("date")
    return bronze_txn.where(
        F.col("customer_id").isNotNull()
        & (day >= F.add_months(end, -WINDOW_MONTHS))
        & (day <= end)
    ).select(
        "customer_id",
        F.trunc(day, "MM").alias("txn_month"),
        F.col("amount_inr").cast("bigint").alias("amount_inr"),
        F.lower(F.trim("transaction_type")).alias("transaction_type"),
        F.col("balance_after_inr").cast("bigint").alias("balance_after_inr"),
        F.col("is_flagged").cast("int").alias("is_flagged"),
    )


def monthly_spend(bronze_txn: DataFrame, as_of: dt.date) -> DataFrame:
    """Spend, instalments, balance and flags per customer and month.

    Partial aggregation leaves at most thirteen rows per customer and map task, so a customer
    with a third of all transactions is already small when it reaches the shuffle.
    """
    txn = recent_transactions(bronze_txn, as_of)
    amount, kind = F.col("amount_inr"), F.col("transaction_type")
    nothing = F.lit(0).cast("bigint")
    return txn.groupBy("customer_id", "txn_month").agg(
        F.sum(F.when(kind.isin(SPEND_TYPES), amount).otherwise(nothing)).alias(
            "monthly_debit_spend_inr"
        ),
        F.sum(F.when(kind == EMI_TYPE, amount).otherwise(nothing)).alias("monthly_emi_paid_inr"),
        F.count(F.when(kind == EMI_TYPE, 1)).alias("emi_payment_count"),
        F.avg("balance_after_inr").alias("avg_balance_inr"),
        F.sum("is_flagged").alias("flagged_txn_count"),
        F.count(F.lit(1)).alias("total_txn_count"),
    )


def customer_txn_agg(monthly: DataFrame, as_of: dt.date) -> DataFrame:
    """Roll the months of each customer up to one row."""
    recent_from = F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -RECENT_MONTHS)
    month, spend, balance = (
        F.col("txn_month"),
        F.col("monthly_debit_spend_inr"),
        F.col("avg_balance_inr"),
    )
    emi_months = F.count(F.when(F.col("emi_payment_count") > 0, 1)).cast("double")
    return monthly.groupBy("customer_id").agg(
        F.round(F.avg(spend), 2).alias("avg_monthly_spend_inr"),
        F.round(F.stddev_samp(spend), 2).alias("spend_volatility_inr"),
        F.max(spend).cast("double").alias("peak_monthly_spend_inr"),
        F.sum("emi_payment_count").alias("emi_payment_count_12m"),
        F.sum("monthly_emi_paid_inr").alias("total_emi_paid_inr_12m"),
        F.round(emi_months / F.count(F.lit(1)), 4).alias("emi_regularity_score"),
        F.avg(F.when(month >= recent_from, balance)).alias("avg_balance_recent_3m"),
        F.avg(F.when(month < recent_from, balance)).alias("avg_balance_earlier_9m"),
        F.sum("flagged_txn_count").alias("total_flagged_txns"),
        F.sum("total_txn_count").alias("total_txns_12m"),
        # the input has one row per customer and month
        F.count("txn_month").alias("active_months_count"),
    )


def join_transactions(credit: DataFrame, txn_agg: DataFrame) -> DataFrame:
    """Bureau snapshot with the transaction roll-up; both sides have one row per customer."""
    bureau = credit.select(
        "customer_id",
        "bureau_pull_date",
        "credit_score",
        F.col("credit_utilisation_pct").alias("bureau_utilisation_pct"),
        "total_credit_limit_inr",
        F.col("total_balance_inr").alias("bureau_balance_inr"),
        "utilisation_band",
        "high_inquiry_flag",
        "delinquency_rate",
        "available_credit_inr",
        "credit_age_band",
    )
    joined = bureau.join(
        txn_agg.withColumn("_has_txn", F.lit(True)), "customer_id", "left"
    )
    return joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0).cast(txn_agg.schema[c].dataType)) for c in TXN_DEFAULTS},
            "no_txn_history_flag": bands.flag(F.col("_has_txn").isNull()),
        }
    ).drop("_has_txn")


def feat_credit_util(credit: DataFrame, txn_agg: DataFrame) -> DataFrame:
    """Credit use and repayment behaviour, one row per customer with a bureau record."""
    earlier, recent = F.col("avg_balance_earlier_9m"), F.col("avg_balance_recent_3m")
    base = join_transactions(credit, txn_agg).withColumns(
        {
            "balance_trend_flag": bands.flag((earlier > 0) & (recent > earlier)),
            "txn_utilisation_estimate": ratio(
                cents(F.col("avg_monthly_spend_inr")), F.col("total_credit_limit_inr") * 100
            ),
            "flagged_txn_rate": F.coalesce(
                ratio(F.col("total_flagged_txns"), F.col("total_txns_12m")), F.lit(0.0)
            ),
        }
    )
    return base.withColumns(
        {
            # 0.30 + 0.15 must be 0.45, not the next smaller double
            "utilisation_change_flag": bands.flag(
                F.col("txn_utilisation_estimate")
                > F.round(F.col("bureau_utilisation_pct") + UTILISATION_GAP, 10)
            ),
            "credit_stress_score": F.col("high_inquiry_flag")
            + F.col("balance_trend_flag")
            + bands.flag(F.col("emi_regularity_score") < LOW_EMI_REGULARITY)
            + bands.flag(F.col("flagged_txn_rate") > HIGH_FLAGGED_RATE),
        }
    )


def audited(df: DataFrame, column: str) -> DataFrame:
    """Add the processing time stamp that every silver table carries."""
    return df.withColumn(column, F.current_timestamp())


def band_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Row count per combination of category columns."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def default_rate_by(df: DataFrame, *columns: str) -> DataFrame:
    """Labelled rows and default rate in percent per group."""
    labelled = df.where(F.col("default_flag").isNotNull())
    return labelled.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("default_flag") * 100, 4).alias("default_rate_pct"),
    )
