"""Reports over a lake: what an analyst asks of the tables that the daily run keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import decisions as deciding
from creditloom.operators import drivers, portfolio, registry, retrieval
from creditloom.plans.pipeline import LakePaths, read_drivers
from creditloom.plans.policy_index import retrieve
from creditloom.sources.snapshots import known_table


def _predictions(spark: SparkSession, lake: str) -> DataFrame:
    return known_table(spark, LakePaths(lake).pd_predictions)


def _dti(spark: SparkSession, lake: str) -> DataFrame:
    return known_table(spark, f"{LakePaths(lake).silver}/feat_dti_ratio")


def decisions(spark: SparkSession, lake: str) -> DataFrame:
    """Decision for every scored application."""
    return deciding.decide_applications(_predictions(spark, lake), _dti(spark, lake))


def customer(spark: SparkSession, lake: str, customer_id: str) -> DataFrame:
    """Applications of one customer, newest score first; an unknown customer is an error."""
    mine = _predictions(spark, lake).where(F.col("customer_id") == customer_id)
    if mine.isEmpty():
        raise LookupError(f"customer {customer_id} is not known")
    profile = portfolio.customer_profile(mine, _dti(spark, lake))
    return profile.orderBy("application_rank")


def application_drivers(
    spark: SparkSession, lake: str, application_id: str, version: str, n: str = "10"
) -> DataFrame:
    """The strongest drivers of an application; an unknown application is an error."""
    found = read_drivers(spark, LakePaths(lake), application_id, version, int(n))
    if found.isEmpty():
        raise LookupError(f"application {application_id} has no drivers of version {version}")
    return found


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "grades": lambda spark, lake: portfolio.grade_distribution(_predictions(spark, lake)),
    "kpis": lambda spark, lake: portfolio.portfolio_kpis(_predictions(spark, lake)),
    "trend": lambda spark, lake: portfolio.pd_trend(_predictions(spark, lake)),
    "agreement": lambda spark, lake: portfolio.model_agreement(_predictions(spark, lake)),
    "decisions": lambda spark, lake: deciding.decision_mix(decisions(spark, lake)),
    "monitoring": lambda spark, lake: portfolio.monitoring_history(
        known_table(spark, LakePaths(lake).model_monitoring)
    ),
    "models": lambda spark, lake: registry.list_models(
        known_table(spark, LakePaths(lake).model_registry)
    ),
    "customer": customer,
    "drivers": application_drivers,
}


def prompt(
    spark: SparkSession, lake: str, question: str, application_id: str | None = None
) -> DataFrame:
    """One prompt: nearest policy chunks, score and drivers of the application, the question."""
    asked = spark.createDataFrame(
        [("asked", question, "asked", application_id)],
        "question_id string, question string, query_id string, application_id string",
    )
    cited = retrieve(spark, f"{lake}/policy_index", asked.select("query_id", "question"))
    contexts = retrieval.context_blocks(cited)
    scored = deciding.latest_prediction(_predictions(spark, lake))
    mine = scored.where(F.col("application_id") == F.lit((application_id or "").upper()))
    lists = (
        known_table(spark, LakePaths(lake).shap_values)
        .join(mine.select("application_id", "model_version"), ["application_id", "model_version"])
        .groupBy("application_id")  # at most ten rows
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "feature_name", "shap_value", "direction"))
            ).alias("drivers")
        )
    )
    context = retrieval.application_context(mine, drivers.driver_text(lists))
    return retrieval.prompt_rows(asked, contexts, context)
