"""The lake over one directory of given tables; intermediate tables are written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import decisions, features, model, retrieval, term_index, training_set
from creditloom.plans.silver import Silver
from creditloom.session import configure, write_stage
from creditloom.sources import given_tables as given


class GivenLake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self.as_of = given.AS_OF
        self.silver = Silver(
            given.bronze_loans(spark, sf_dir),
            given.bronze_bureau(spark, sf_dir),
            given.bronze_transactions(spark, sf_dir),
            given.AS_OF,
        )

    def table(self, name: str) -> DataFrame:
        return given.table(self.spark, self.sf_dir, name)

    @property
    def predictions(self) -> DataFrame:
        return given.surrogate_predictions(self.spark, self.sf_dir)

    @cached_property
    def scoring(self) -> DataFrame:
        frame = training_set.scoring_frame(self.silver.feat_dti_ratio, self.silver.feat_credit_util)
        return write_stage(frame, "scoring_frame")

    @property
    def scored_once(self) -> DataFrame:
        """The scoring frame for one pass over some of its columns: neither it nor the ratios are
        written, and both joins are on the customer, so the applications are shuffled once."""
        silver = self.silver
        dti = features.feat_dti_ratio(silver.stg_loans, silver.stg_credit)
        return training_set.scoring_frame(dti, silver.feat_credit_util)

    @property
    def training(self) -> DataFrame:
        return self.scoring.where(F.col(training_set.LABEL).isNotNull())

    @cached_property
    def trained(self) -> model.TrainingRun:
        return model.train(self.training)

    @cached_property
    def trained_full(self) -> model.PdModel:
        return model.fit(self.training, model.FULL)

    @cached_property
    def decided(self) -> DataFrame:
        decided = decisions.decide_applications(self.predictions, self.silver.feat_dti_ratio)
        return write_stage(decided, "decisions")

    @cached_property
    def chunks(self) -> DataFrame:
        return write_stage(
            retrieval.chunk_documents(self.table("documents"), source="doc_id"), "chunks"
        )

    @cached_property
    def questions(self) -> DataFrame:
        """Every user turn asks about one application."""
        conv = F.col("conv_id")
        turns = self.table("conversations").where(F.col("role") == "user")
        rows = turns.select(
            F.concat_ws("-", conv.cast("string"), F.col("turn").cast("string")).alias("question_id"),
            F.col("text").alias("question"),
            F.lower(given.application_key(conv)).alias("application_id"),
        )
        return write_stage(rows.withColumn("query_id", F.col("question_id")), "questions")

    @cached_property
    def question_hits(self) -> DataFrame:
        """The chunks nearest to each question, over all chunks of all documents."""
        counts = write_stage(term_index.counted(self.chunks), "counted")
        index = term_index.build_index(counts)
        asked = term_index.counted(self.questions, "query_id", "question")
        hits, _ = term_index.search(index, asked, retrieval.TOP_K)
        return write_stage(hits, "question-hits")

    @property
    def labelled_scores(self) -> DataFrame:
        """Scores of all versions with the known outcome of the application."""
        labels = self.silver.stg_loans.select("application_id", "default_flag").where(
            F.col("default_flag").isNotNull()
        )
        scores = self.predictions.select(
            "application_id",
            "pd_probability_rf",
            "pd_probability_lr",
            "pd_probability_ens",
            "pd_prediction",
            "model_version",
        )
        return scores.join(labels, "application_id")


_LAKES: dict[tuple[str, str], GivenLake] = {}


def lake(spark: SparkSession, sf_dir: str) -> GivenLake:
    """The lake of this application over ``sf_dir``; silver is built once and shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        _LAKES[key] = GivenLake(spark, sf_dir)
    return _LAKES[key]
