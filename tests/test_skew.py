"""Joins on a hot key: the written right side lets adaptive execution split the hot partition."""

from conftest import plan_of
from pyspark.sql import functions as F

from creditloom.operators import decisions, features, retrieval, staging, training_set
from creditloom.session import write_stage
from creditloom.sources import given_tables as given

SMALL = {
    "autoBroadcastJoinThreshold": "-1",
    "adaptive__autoBroadcastJoinThreshold": "-1",
    "adaptive__skewJoin__skewedPartitionThresholdInBytes": "1b",
    "adaptive__skewJoin__skewedPartitionFactor": "1.0",
    "adaptive__advisoryPartitionSizeInBytes": "4k",
}


def _hot_loans(spark, sf):
    """Two thirds of all loans belong to one customer."""
    loans = staging.stg_loans(given.bronze_loans(spark, sf))
    order = F.substring("application_id", 4, 20).cast("bigint")
    hot = F.when(order % 3 != 0, "CUST000000000001").otherwise(F.col("customer_id"))
    return write_stage(loans.withColumn("customer_id", hot).repartition(16), "hot_loans")


def test_bureau_join_splits_a_hot_customer(spark, sf, conf):
    loans = _hot_loans(spark, sf)
    credit = write_stage(staging.stg_credit(given.bronze_bureau(spark, sf)), "credit")
    plain = sorted(features.feat_dti_ratio(loans, credit).collect())
    conf(**SMALL)
    spread = features.feat_dti_ratio(loans, credit)
    assert "skew=true" in plan_of(spread)
    assert sorted(spread.collect()) == plain


def test_scoring_frame_and_batch_split_hot_keys(spark, sf, conf):
    loans = _hot_loans(spark, sf)
    credit = write_stage(staging.stg_credit(given.bronze_bureau(spark, sf)), "credit")
    dti = write_stage(features.feat_dti_ratio(loans, credit).repartition(16), "dti")
    months = features.monthly_spend(given.bronze_transactions(spark, sf), given.AS_OF)
    agg = features.customer_txn_agg(months, given.AS_OF)
    util = write_stage(features.feat_credit_util(credit, agg), "util")
    ids = write_stage(
        spark.range(0, 20000, numPartitions=16).select(
            F.when(F.col("id") % 3 == 0, "app000000000005")
            .otherwise(F.format_string("APP%012d", F.col("id") % 1500))
            .alias("application_id")
        ),
        "ids",
    )
    predictions = given.surrogate_predictions(spark, sf)
    decided = write_stage(decisions.decide_applications(predictions, dti), "decided")
    conf(**SMALL)
    assert "skew=true" in plan_of(training_set.scoring_frame(dti, util))
    scored = decisions.score_ids(ids, decided)
    assert "skew=true" in plan_of(scored)
    assert scored.count() == 20000


def test_monthly_spend_aggregates_before_the_shuffle(spark, sf):
    months = features.monthly_spend(given.bronze_transactions(spark, sf), given.AS_OF)
    plan = months._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("HashAggregate"), plan.rindex("partial_sum")
    assert final < plan.index("Exchange hashpartitioning(customer_id") < partial


def test_prompts_split_a_hot_application(spark, conf):
    questions = write_stage(
        spark.range(0, 20000, numPartitions=16).select(
            F.col("id").cast("string").alias("question_id"),
            F.lit("why").alias("question"),
            (F.col("id") % 10).cast("int").alias("query_id"),
            F.when(F.col("id") % 3 == 0, "A1").otherwise(F.concat(F.lit("A"), "id")).alias(
                "application_id"
            ),
        ),
        "questions",
    )
    contexts = write_stage(
        spark.range(10).select(F.col("id").cast("int").alias("query_id"), F.lit("t").alias("policy_context")),
        "contexts",
    )
    applications = write_stage(
        spark.range(20000).select(
            F.concat(F.lit("A"), "id").alias("application_id"),
            F.lit("c").alias("customer_block"),
            F.lit("d").alias("driver_block"),
        ),
        "applications",
    )
    conf(**SMALL)
    prompts = retrieval.prompt_rows(questions, contexts, applications)
    assert "skew=true" in plan_of(prompts)
    assert prompts.count() == 20000
