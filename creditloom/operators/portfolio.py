"""Portfolio reports over the predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.bands import ALL_GRADES
from creditloom.operators.decisions import latest_prediction, with_loan_context
from creditloom.operators.ordering import with_group_rank

HIGH_RISK_GRADES = ["D", "E"]
AGREEMENT_GAP = 0.10


def grade_distribution(predictions: DataFrame) -> DataFrame:
    pd = "pd_probability_ens"
    return (
        predictions.groupBy("risk_grade")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg(pd), 6).alias("avg_pd"),
            F.min(pd).alias("min_pd"),
            F.max(pd).alias("max_pd"),
        )
        .orderBy("risk_grade")
    )


def portfolio_kpis(predictions: DataFrame) -> DataFrame:
    """Total, average PD and high-risk share in one pass; zeros on an empty table."""
    high = F.count_if(F.col("risk_grade").isin(HIGH_RISK_GRADES))
    total = F.count(F.lit(1))
    return predictions.agg(
        total.alias("total_applications"),
        F.round(F.coalesce(F.avg("pd_probability_ens"), F.lit(0.0)), 6).alias("portfolio_avg_pd"),
        high.alias("high_risk_count"),
        F.round(F.when(total > 0, high * F.lit(100.0) / total).otherwise(0.0), 6).alias("high_risk_pct"),
    )


def pd_trend(predictions: DataFrame, days: int = 30) -> DataFrame:
    """Average PD and score count of the newest ``days`` scoring days."""
    return (
        predictions.groupBy(F.col("scored_at").cast("date").alias("day"))
        .agg(
            F.round(F.avg("pd_probability_ens"), 6).alias("avg_pd"),
            F.count(F.lit(1)).alias("scored_count"),
        )
        .orderBy(F.col("day").desc())
        .limit(days)
    )


def grade_share_columns() -> list[Column]:
    """Aggregate expressions: percentage of every grade, absent grades as 0."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return [
        F.round(F.count_if(F.col("risk_grade") == g) * F.lit(100.0) / total, 2).alias(
            f"pct_grade_{g.lower()}"
        )
        for g in ALL_GRADES
    ]


def grade_shares(predictions: DataFrame) -> DataFrame:
    return predictions.agg(*grade_share_columns())


def with_agreement(predictions: DataFrame) -> DataFrame:
    """Whether the two models of the ensemble agree on a row."""
    gap = F.round(F.abs(F.col("pd_probability_rf") - F.col("pd_probability_lr")), 6)
    return predictions.withColumn("models_agree", gap < AGREEMENT_GAP)


def model_agreement(predictions: DataFrame) -> DataFrame:
    return (
        with_agreement(predictions)
        .groupBy("model_version")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("models_agree").alias("agreeing"),
            F.round(F.avg(F.col("models_agree").cast("int")), 6).alias("agreement_share"),
        )
    )


def customer_profile(predictions: DataFrame, dti: DataFrame) -> DataFrame:
    """Every customer's applications, newest score first (``application_rank`` = 1).

    One row per application and not one array per customer: a customer may hold a large part
    of the table.  The rank comes from sorted blocks for the same reason.
    """
    rows = with_loan_context(latest_prediction(predictions), dti)
    return with_group_rank(
        rows,
        ["customer_id"],
        [F.col("scored_at").desc(), F.col("application_id")],
        "application_rank",
    )


def monitoring_history(monitoring: DataFrame, n: int = 60) -> DataFrame:
    """Newest monitoring snapshots first."""
    return monitoring.orderBy(F.col("snapshot_date").desc(), F.col("model_version")).limit(n)
