"""Spend per customer and month from partial sums that days of landing leave behind.

The state of a landing has one row per customer and transaction day: sums and counts, which add
up.  A landing that is repeated replaces its own state, a late one brings rows of old days, and
neither makes other landings read their transactions again.  Months are put together from the
states when asked, since the window of twelve months may begin inside one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.features import EMI_TYPE, SPEND_TYPES, WINDOW_MONTHS
from creditloom.sources.snapshots import read_parts, replace_part

_SUMS = ["spend", "emi_paid", "emi_payments", "balance", "balances", "flagged", "transactions"]


def day_state(bronze_txn: DataFrame) -> DataFrame:
    """customer_id, day and what its transactions add up to; summed up before the shuffle."""
    kind = F.lower(F.trim("transaction_type"))
    amount, balance = (F.col(c).cast("bigint") for c in ("amount_inr", "balance_after_inr"))
    nothing = F.lit(0).cast("bigint")
    rows = bronze_txn.select(
        "customer_id",
        F.col("transaction_date").cast("date").alias("day"),
        F.when(kind.isin(SPEND_TYPES), amount).otherwise(nothing).alias("spend"),
        F.when(kind == EMI_TYPE, amount).otherwise(nothing).alias("emi_paid"),
        (kind == EMI_TYPE).cast("bigint").alias("emi_payments"),
        balance.alias("balance"),
        balance.isNotNull().cast("bigint").alias("balances"),
        F.col("is_flagged").cast("bigint").alias("flagged"),
        F.lit(1).cast("bigint").alias("transactions"),
    ).where(F.col("customer_id").isNotNull() & F.col("day").isNotNull())
    return merged(rows)


def merged(states: DataFrame) -> DataFrame:
    """States of several landings as one; sums over nothing but nulls stay null."""
    return states.groupBy("customer_id", "day").agg(*[F.sum(c).alias(c) for c in _SUMS])


def spend_of_states(states: DataFrame, as_of: dt.date) -> DataFrame:
    """The same table as ``features.monthly_spend`` over all landed rows."""
    end = F.lit(as_of).cast("date")
    window = (F.col("day") >= F.add_months(end, -WINDOW_MONTHS)) & (F.col("day") <= end)
    return (
        states.where(window)
        .groupBy("customer_id", F.trunc("day", "MM").alias("txn_month"))
        .agg(
            F.sum("spend").alias("monthly_debit_spend_inr"),
            F.sum("emi_paid").alias("monthly_emi_paid_inr"),
            F.coalesce(F.sum("emi_payments"), F.lit(0)).alias("emi_payment_count"),
            F.when(
                F.sum("balances") > 0, F.sum("balance").cast("double") / F.sum("balances")
            ).alias("avg_balance_inr"),
            F.sum("flagged").alias("flagged_txn_count"),
            F.sum("transactions").alias("total_txn_count"),
        )
    )


def keep_state(bronze_day: DataFrame, path: str, landed_on: dt.date) -> None:
    """Keep the state of one landing; a repeated landing replaces its own."""
    replace_part(day_state(bronze_day), path, landed_on.isoformat())


def kept_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all landings; at least one must have been kept."""
    states = read_parts(spark, path)
    if states is None:
        raise LookupError(f"no monthly state in {path}")
    return states
