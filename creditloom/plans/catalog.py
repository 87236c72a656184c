"""Registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import bands
from creditloom.operators import (
    decisions,
    drift,
    drift_state,
    drivers,
    features,
    latest,
    metrics,
    model,
    monthly_state,
    portfolio,
    quality,
    registry,
    retrieval,
    staging,
    term_index,
    training_set,
    unique_state,
    vector_index,
)
from creditloom.plans.given_lake import GivenLake, lake
from creditloom.session import configure, stage_path, write_stage
from creditloom.sources import audit, buckets, landing

_QUERIES: dict[str, Callable[[GivenLake], DataFrame]] = {}


def query(fn: Callable[[GivenLake], DataFrame]) -> Callable[[GivenLake], DataFrame]:
    """Register a function of the lake under its own name."""
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(lake(configure(spark), sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round averages whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------------------- silver


@query
def stg_loans(gl: GivenLake) -> DataFrame:
    return staging.stg_loans(gl.silver.bronze_loans)


@query
def credit_tier_mix(gl: GivenLake) -> DataFrame:
    return features.band_counts(gl.silver.stg_loans, "credit_risk_tier")


@query
def stg_credit(gl: GivenLake) -> DataFrame:
    return staging.stg_credit(gl.silver.bronze_bureau)


@query
def feat_dti_ratio(gl: GivenLake) -> DataFrame:
    return features.feat_dti_ratio(gl.silver.stg_loans, gl.silver.stg_credit)


@query
def dti_tier_mix(gl: GivenLake) -> DataFrame:
    return features.band_counts(gl.silver.feat_dti_ratio, "dti_risk_tier", "combined_risk_flag")


@query
def monthly_spend(gl: GivenLake) -> DataFrame:
    months = features.monthly_spend(gl.silver.bronze_transactions, gl.as_of)
    return _rounded(months, 6, "avg_balance_inr")


@query
def relanded_spend(gl: GivenLake) -> DataFrame:
    """Transactions landed as a full extract on two days: the rows of the second day count."""
    base = stage_path(gl.spark, "bronze")
    days = (dt.date(2001, 7, 31), gl.as_of)
    for day in days:
        landing.write_bronze(gl.silver.bronze_transactions, base, "transactions", day)
    rows = landing.read_extract(gl.spark, base, "transactions", days[-1])
    months = features.monthly_spend(rows, gl.as_of)
    return _rounded(months, 6, "avg_balance_inr")


@query
def merged_spend(gl: GivenLake) -> DataFrame:
    """Transactions landed as increments on three days, the second one twice: states are merged."""
    path = stage_path(gl.spark, "monthly-state")
    rows = gl.silver.bronze_transactions
    third = F.pmod(F.xxhash64("transaction_id"), F.lit(3))
    for n in (0, 1, 1, 2):
        monthly_state.keep_state(rows.where(third == n), path, gl.as_of - dt.timedelta(3 - n))
    months = monthly_state.spend_of_states(
        monthly_state.kept_states(gl.spark, path), gl.as_of
    )
    return _rounded(months, 6, "avg_balance_inr")


def _retyped_bronze(gl: GivenLake) -> str:
    """Bureau records landed on three days: scores as numbers, as text, and with decimals."""
    base, rows = stage_path(gl.spark, "bronze"), gl.silver.bronze_bureau
    score = F.col("credit_score")
    landed = [score.cast("bigint"), score.cast("string"), score.cast("double") + 0.5]
    third = F.ascii(F.right("customer_id", F.lit(1))) % 3
    for n, value in enumerate(landed):
        day = rows.where(third == n).withColumn("credit_score", value)
        columns = ("customer_id", "credit_score", "hard_inquiries_6m")[: 3 if n else 2]
        landing.write_bronze(day.select(*columns), base, "credit_bureau", dt.date(2001, 7, n + 1))
    return base


@query
def retyped_history(gl: GivenLake) -> DataFrame:
    """The history of a source whose columns came, and changed their type, from day to day."""
    return landing.read_bronze(gl.spark, _retyped_bronze(gl), "credit_bureau").groupBy(
        F.col("credit_score").rlike("[.]").alias("with_decimals"),
        F.col("hard_inquiries_6m").isNull().alias("without_inquiries"),
    ).agg(F.sum(F.col("credit_score").cast("double")).alias("sum_of_scores"))


@query
def landed_types(gl: GivenLake) -> DataFrame:
    return landing.landed_types(gl.spark, _retyped_bronze(gl), "credit_bureau")


def _txn_agg(gl: GivenLake) -> DataFrame:
    months = features.monthly_spend(gl.silver.bronze_transactions, gl.as_of)
    return features.customer_txn_agg(months, gl.as_of)


@query
def customer_txn_agg(gl: GivenLake) -> DataFrame:
    return _rounded(_txn_agg(gl), 6, "avg_balance_recent_3m", "avg_balance_earlier_9m")


@query
def feat_credit_util(gl: GivenLake) -> DataFrame:
    util = features.feat_credit_util(gl.silver.stg_credit, _txn_agg(gl))
    return _rounded(util, 6, "avg_balance_recent_3m", "avg_balance_earlier_9m")


@query
def stress_mix(gl: GivenLake) -> DataFrame:
    return features.band_counts(gl.silver.feat_credit_util, "credit_stress_score")


# --------------------------------------------------------------------------- quality


def _silver_report(gl: GivenLake) -> DataFrame:
    return quality.run_suite(gl.silver.read_once(), quality.SILVER_CHECKS)


@query
def dq_report(gl: GivenLake) -> DataFrame:
    bronze_report = quality.run_suite(_bronze(gl), quality.BRONZE_CHECKS)
    return _silver_report(gl).unionByName(bronze_report)


@query
def dq_summary(gl: GivenLake) -> DataFrame:
    return quality.run_summary(_silver_report(gl), models_run=len(gl.silver.read_once()))


@query
def dq_failing_values(gl: GivenLake) -> DataFrame:
    repeated = quality.Check("transactions", "transaction_id", "unique")
    return quality.failing_values(gl.silver.bronze_transactions, repeated)


@query
def dq_incremental_failing(gl: GivenLake) -> DataFrame:
    """The same groups, found landing by landing: rows of three days, dealt by all columns."""
    rows, key = gl.silver.bronze_transactions, "transaction_id"
    third = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    rows = write_stage(rows.select(key, third.alias("_third")), "landings")
    path, days, failing = stage_path(gl.spark, "key-bitmaps"), [], None
    for n in range(3):
        new = rows.where(F.col("_third") == n)
        earlier = rows.where(F.col("_third") < n) if n else None
        bitmaps = unique_state.kept_bitmaps(gl.spark, path, days)
        found, _ = unique_state.repeated_keys(new, earlier, bitmaps, key)
        failing = write_stage(unique_state.failing_after(failing, found, key), "failing")
        days.append(gl.as_of - dt.timedelta(3 - n))
        unique_state.keep_bitmaps(new, path, days[-1], key)
    return failing


# --------------------------------------------------------------------------- training set


@query
def scoring_frame(gl: GivenLake) -> DataFrame:
    return training_set.scoring_frame(gl.silver.feat_dti_ratio, gl.silver.feat_credit_util)


@query
def training_frame(gl: GivenLake) -> DataFrame:
    return training_set.training_frame(gl.silver.feat_dti_ratio, gl.silver.feat_credit_util)


@query
def default_rate_by(gl: GivenLake) -> DataFrame:
    return features.default_rate_by(gl.silver.feat_dti_ratio, "credit_risk_tier", "dti_risk_tier")


@query
def feature_nulls(gl: GivenLake) -> DataFrame:
    return training_set.null_counts(gl.training, training_set.FULL_NUMERIC)


@query
def feature_medians(gl: GivenLake) -> DataFrame:
    return training_set.exact_medians(gl.training, training_set.FULL_NUMERIC)


@query
def fold_medians(gl: GivenLake) -> DataFrame:
    """The medians that each of five folds learns, of the features of the main profile."""
    rows = gl.training.select(
        "application_id", training_set.LABEL, *training_set.FULL_NUMERIC
    )
    folds = write_stage(training_set.cv_folds(rows), "folds")
    found = training_set.fold_medians(folds, training_set.FULL_NUMERIC, 5)
    rows = [(i, c, m) for i, medians in enumerate(found) for c, m in medians.items()]
    return gl.spark.createDataFrame(rows, "fold int, feature string, median_value double")


@query
def imputed_features(gl: GivenLake) -> DataFrame:
    rows = training_set.exact_medians(gl.training, training_set.FULL_NUMERIC).collect()
    medians = {r["feature"]: r["median_value"] for r in rows}  # one row per feature
    filled = training_set.impute(gl.scoring, medians, training_set.FULL_CATEGORICAL)
    return filled.select(
        "application_id", *training_set.FULL_NUMERIC, *training_set.FULL_CATEGORICAL
    )


@query
def one_hot(gl: GivenLake) -> DataFrame:
    levels = training_set.category_levels(gl.training, training_set.VERSIONED_CATEGORICAL)
    encoded = training_set.one_hot(gl.scoring, levels)
    names = [f"{c}_{level}" for c, found in levels.items() for level in found]
    return encoded.select("application_id", *names)


def _labelled_loans(gl: GivenLake) -> DataFrame:
    """The training rows without their features: these are joined from tables with one row per
    customer, so they neither add nor drop a row."""
    return gl.silver.stg_loans.where(F.col(training_set.LABEL).isNotNull())


@query
def class_weights(gl: GivenLake) -> DataFrame:
    return _rounded(training_set.class_weights(_labelled_loans(gl)), 8, "class_weight")


@query
def time_split(gl: GivenLake) -> DataFrame:
    split = training_set.time_split(_labelled_loans(gl))
    return split.select("application_id", "application_date", "split")


@query
def cv_folds(gl: GivenLake) -> DataFrame:
    folds = training_set.cv_folds(gl.training.select("application_id", "default_flag"))
    return folds.groupBy("default_flag", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("application_id").alias("first_application")
    )


# --------------------------------------------------------------------------- serving


@query
def latest_prediction(gl: GivenLake) -> DataFrame:
    newest = decisions.latest_prediction(gl.predictions)
    return decisions.with_loan_context(newest, gl.silver.feat_dti_ratio)


@query
def grade_distribution(gl: GivenLake) -> DataFrame:
    return portfolio.grade_distribution(gl.predictions)


@query
def portfolio_kpis(gl: GivenLake) -> DataFrame:
    return portfolio.portfolio_kpis(gl.predictions)


@query
def pd_trend(gl: GivenLake) -> DataFrame:
    return portfolio.pd_trend(gl.predictions)


@query
def grade_shares(gl: GivenLake) -> DataFrame:
    return portfolio.grade_shares(gl.predictions)


@query
def model_agreement(gl: GivenLake) -> DataFrame:
    return portfolio.model_agreement(gl.predictions)


@query
def customer_profile(gl: GivenLake) -> DataFrame:
    return portfolio.customer_profile(gl.predictions, gl.silver.feat_dti_ratio)


@query
def risk_grade(gl: GivenLake) -> DataFrame:
    pd = F.col("pd_probability_rf")
    graded = gl.predictions.withColumn("grade", bands.risk_grade(pd))
    return graded.groupBy("model_version", "grade").agg(
        F.count(F.lit(1)).alias("n"), F.min(pd).alias("min_pd"), F.max(pd).alias("max_pd")
    )


@query
def pd_label(gl: GivenLake) -> DataFrame:
    pd = F.col("pd_probability_ens")
    labelled = gl.predictions.withColumn("label", bands.pd_label(pd))
    return labelled.groupBy("model_version", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(pd).alias("min_pd"), F.max(pd).alias("max_pd")
    )


_DECISION_KEYS = ["application_id", "customer_id", "risk_grade", "pd_probability_ens"]


@query
def decisions_(gl: GivenLake) -> DataFrame:
    decided = decisions.decide_applications(gl.predictions, gl.silver.feat_dti_ratio)
    return decided.select(*_DECISION_KEYS, "decision", "confidence")


_QUERIES["decisions"] = _QUERIES.pop("decisions_")


@query
def decision_reasons(gl: GivenLake) -> DataFrame:
    decided = decisions.decide_applications(gl.predictions, gl.silver.feat_dti_ratio)
    return decided.select(
        "application_id",
        "decision",
        F.concat_ws(decisions.REASON_SEPARATOR, "reasoning").alias("reasoning"),
        F.concat_ws(decisions.REASON_SEPARATOR, "policy_refs").alias("policy_refs"),
    )


@query
def decision_mix(gl: GivenLake) -> DataFrame:
    return decisions.decision_mix(gl.decided)


@query
def batch_score(gl: GivenLake) -> DataFrame:
    """Every line item asks for the score of its order; some ask for an order that is unknown."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    asked = F.when(line == 7, F.concat(F.lit("zzz"), order)).when(line == 6, F.lit("  "))
    known = F.concat(F.lit(" app"), F.lpad(order, 12, "0"))
    ids = gl.table("lineitem").select(F.coalesce(asked, known).alias("application_id"))
    return decisions.score_ids(ids, gl.decided)


# --------------------------------------------------------------------------- metrics, drift

_ENS = "pd_probability_ens"


@query
def roc_auc(gl: GivenLake) -> DataFrame:
    return metrics.roc_auc(gl.labelled_scores, _ENS, "default_flag")


@query
def avg_precision(gl: GivenLake) -> DataFrame:
    return metrics.average_precision(gl.labelled_scores, _ENS, "default_flag")


@query
def roc_points(gl: GivenLake) -> DataFrame:
    points = metrics.roc_points(gl.labelled_scores, "pd_probability_rf", "default_flag")
    return _rounded(points, 8, "fpr", "tpr")


@query
def pr_points(gl: GivenLake) -> DataFrame:
    points = metrics.pr_points(gl.labelled_scores, "pd_probability_rf", "default_flag")
    return _rounded(points, 8, "precision", "recall")


@query
def classification_report(gl: GivenLake) -> DataFrame:
    return metrics.classification_report(gl.labelled_scores, "pd_prediction", "default_flag")


@query
def ks_two_sample(gl: GivenLake) -> DataFrame:
    scored_year = F.year("scored_at")
    return drift.ks_two_sample(
        gl.predictions, _ENS, scored_year == 1995, scored_year == 2001
    )


@query
def drift_baseline(gl: GivenLake) -> DataFrame:
    return drift.on_extreme_day(gl.predictions, "min")


@query
def drift_snapshot(gl: GivenLake) -> DataFrame:
    return drift.drift_snapshot(gl.predictions, gl.as_of, grain="year")


# --------------------------------------------------------------------------- upsert


@query
def drift_states(gl: GivenLake) -> DataFrame:
    """What each month leaves behind of its scores."""
    return drift_state.score_states(gl.predictions, grain="month", points=100)


@query
def drift_state_gaps(gl: GivenLake) -> DataFrame:
    """The gap between the scores of each month and the one before, from their states alone."""
    states = write_stage(drift_states(gl), "drift-states")
    found = drift_state.gaps(states, drift_state.neighbours(states))
    return found.withColumn("gap", F.round("gap", 9))


_SCORE_KEYS = ["application_id", "model_version"]


def _two_runs(gl: GivenLake) -> tuple[DataFrame, DataFrame]:
    """Scores, and those of a later run that scores some again and new ones too."""
    keys = _SCORE_KEYS
    scores = gl.predictions.select(*keys, _ENS, "risk_grade", "scored_at")
    target = scores.where(F.col("model_version") != "v2")
    rerun = scores.where(F.col("model_version") != "v0").withColumn(
        _ENS, F.round(1 - F.col(_ENS), 6)
    )
    return target, rerun.withColumn("risk_grade", bands.risk_grade(F.col(_ENS)))


@query
def upsert_latest(gl: GivenLake) -> DataFrame:
    """Version v0 scores, refreshed by a later run that also scores new applications."""
    target, rerun = _two_runs(gl)
    return latest.upsert(target, rerun, _SCORE_KEYS, update_columns=[_ENS, "risk_grade"])


@query
def bucketed_upsert(gl: GivenLake) -> DataFrame:
    """The same merge into a keyed table of which only touched buckets are rewritten."""
    target, rerun = _two_runs(gl)
    path = stage_path(gl.spark, "keyed")
    buckets.merge_keyed(target, path, _SCORE_KEYS, buckets=16)
    buckets.merge_keyed(rerun, path, _SCORE_KEYS, [_ENS, "risk_grade"], buckets=16)
    return buckets.read_keyed(gl.spark, path)


@query
def monitoring_history(gl: GivenLake) -> DataFrame:
    """One snapshot per model version, newest first."""
    snapshots = [
        drift.drift_snapshot(
            gl.predictions, gl.as_of, grain="year", model_version=v
        )
        for v in VERSIONS
    ]
    return portfolio.monitoring_history(reduce(DataFrame.unionByName, snapshots))


# --------------------------------------------------------------------------- landing, audit


def _year_end(text_date: str) -> Column:
    return F.make_date(F.year(F.col(text_date).cast("date")), F.lit(12), F.lit(31))


_LANDED_AT = dt.datetime(2002, 1, 1)
_SOURCE_DATES = {
    "loan_applications": "application_date",
    "credit_bureau": "bureau_pull_date",
    "transactions": "transaction_date",
}


def _bronze(gl: GivenLake) -> dict[str, DataFrame]:
    return {
        "loan_applications": gl.silver.bronze_loans,
        "credit_bureau": gl.silver.bronze_bureau,
        "transactions": gl.silver.bronze_transactions,
    }


def _landed_loans(gl: GivenLake) -> DataFrame:
    """Loans as landed by one run per year."""
    return landing.with_ingest_metadata(
        gl.silver.bronze_loans,
        _year_end("application_date"),
        ingested_at=_LANDED_AT,
        source_file="loan_applications.csv",
    )


@query
def bronze_metadata(gl: GivenLake) -> DataFrame:
    landed = _landed_loans(gl)
    return landed.withColumn(
        "_bronze_ingested_at", F.col("_bronze_ingested_at").cast("timestamp_ntz")
    )


@query
def bronze_partition_read(gl: GivenLake) -> DataFrame:
    base = stage_path(gl.spark, "bronze")
    landing.write_bronze(
        _landed_loans(gl), base, "loan_applications", F.col("_bronze_execution_date")
    )
    day = dt.date(1998, 12, 31)
    landed = landing.read_bronze(gl.spark, base, "loan_applications", day)
    return landed.select("application_id", "loan_amount_inr", "_bronze_execution_date")


@query
def ingest_profile(gl: GivenLake) -> DataFrame:
    profiles = [audit.profile_ingest(df, name) for name, df in _bronze(gl).items()]
    return reduce(DataFrame.unionByName, profiles).select(
        "source_name",
        "row_count",
        F.size("column_names").alias("columns"),
        F.element_at("column_dtypes", "customer_id").alias("customer_id_type"),
        "row_hash",
    )


def _audit_events(gl: GivenLake) -> DataFrame:
    """A run per source and year logs that it started and then how many rows it landed."""
    parts = []
    for source, df in _bronze(gl).items():
        day = _year_end(_SOURCE_DATES[source]).alias("execution_date")
        counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
        started = F.col("execution_date").cast("timestamp_ntz")
        events = F.array(
            F.struct(
                F.lit("running").alias("status"),
                F.lit(None).cast("bigint").alias("row_count"),
                started.alias("ingested_at"),
            ),
            F.struct(
                F.lit("success").alias("status"),
                F.col("rows").alias("row_count"),
                (started + F.expr("interval 1 minute")).alias("ingested_at"),
            ),
        )
        run = F.concat(F.lit("run-"), F.col("execution_date").cast("string"))
        parts.append(
            counts.select(
                run.alias("run_id"),
                F.lit(source).alias("source_name"),
                "execution_date",
                F.inline(events),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query
def audit_latest(gl: GivenLake) -> DataFrame:
    return audit.latest_audit(_audit_events(gl))


#: From this year on a source has its new column and no longer its old one.
_CHANGE_YEAR = 1996
_CHANGED_COLUMNS = {
    "loan_applications": ("default_flag", "collateral_value"),
    "credit_bureau": ("hard_inquiries_6m", "oldest_account_months"),
}


def _snapshots(gl: GivenLake) -> DataFrame:
    """A snapshot per source and year; the columns of two sources change with the years."""
    parts = []
    for source, df in _bronze(gl).items():
        day = _SOURCE_DATES[source]
        late = F.year(F.col(day).cast("date")) >= _CHANGE_YEAR
        new, old = _CHANGED_COLUMNS.get(source, ("", ""))
        for rows, gone in ((df.where(~late), new), (df.where(late), old)):
            columns = [c for c in df.columns if c != gone]
            parts.append(audit.schema_snapshot(rows, source, _year_end(day), columns))
    return reduce(DataFrame.unionByName, parts)


@query
def schema_snapshot(gl: GivenLake) -> DataFrame:
    return _snapshots(gl).select(
        "source_name",
        "snapshot_date",
        audit.schema_json(F.col("column_dtypes")).alias("column_dtypes"),
        "schema_hash",
    )


@query
def schema_drift(gl: GivenLake) -> DataFrame:
    compared = audit.schema_drift(_snapshots(gl))
    listed = {c: F.concat_ws(",", c) for c in ("added", "removed", "retyped")}
    return compared.withColumns(listed)


# --------------------------------------------------------------------------- registry

VERSIONS = ["v0", "v1", "v2"]


def _model_rows(gl: GivenLake) -> DataFrame:
    """One row per scored model version with its metrics, ready to be registered."""
    scores = {
        "rf_auc": "pd_probability_rf",
        "lr_auc": "pd_probability_lr",
        "ensemble_auc": "pd_probability_ens",
    }
    cells = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("score")) for m, c in scores.items()]
    long = gl.labelled_scores.select(
        "model_version", "default_flag", F.inline(F.array(*cells))
    )
    aucs = metrics.roc_auc(long, "score", "default_flag", by=["model_version", "metric"])
    wide = aucs.groupBy("model_version").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("auc"))).alias(m) for m in scores],
        F.max(F.col("positives") + F.col("negatives")).alias("test_rows"),
    )
    number = F.substring("model_version", 2, 10).cast("int")
    registered = F.timestamp_add("DAY", number, F.lit(str(_LANDED_AT)).cast("timestamp"))
    rows = wide.withColumns(
        {
            "avg_precision": F.lit(None).cast("double"),
            "feature_count": F.lit(22),
            "train_rows": F.lit(0).cast("bigint"),
            "trained_at": registered,
            "registered_at": registered,
            "notes": F.lit(None).cast("string"),
        }
    )
    return write_stage(rows, "model_rows")


def _registry(gl: GivenLake) -> DataFrame:
    models = _model_rows(gl)
    table = gl.spark.createDataFrame([], registry.REGISTRY_SCHEMA)
    for v in VERSIONS:
        table = registry.register(table, models.where(F.col("model_version") == v), promote=True)
    return table


def _registry_view(table: DataFrame) -> DataFrame:
    at = F.col("registered_at").cast("timestamp_ntz").alias("registered_at")
    return table.select("model_version", "ensemble_auc", "test_rows", "status", at)


@query
def registry_transition(gl: GivenLake) -> DataFrame:
    return _registry_view(_registry(gl))


@query
def model_registry(gl: GivenLake) -> DataFrame:
    """The listing after version v0 was promoted by hand."""
    promoted = registry.promote(_registry(gl), "v0")
    return _registry_view(registry.list_models(promoted))


# --------------------------------------------------------------------------- live scoring, drivers

#: Given coefficients, so that scores and drivers can be restated in SQL: (weight, centre).
WEIGHTS = {
    "annual_income_inr": (-0.000001, 300000.0),
    "loan_term_months": (0.002, 48.0),
    "credit_score": (-0.004, 600.0),
    "loan_to_income_ratio": (0.35, 1.5),
    "collateral_coverage_ratio": (-0.01, 5.0),
    "dti_ratio": (0.8, 0.4),
    "delinquency_rate": (0.7, 0.1),
    "hard_inquiries_6m": (0.05, 2.0),
    "bureau_utilisation_pct": (0.6, 0.5),
    "emi_regularity_score": (-0.3, 0.5),
    "credit_stress_score": (0.25, 1.0),
    "total_txns_12m": (-0.01, 5.0),
}


@query
def score_missing(gl: GivenLake) -> DataFrame:
    """Applications last scored before 2000 keep their score, all others are scored now."""
    old = gl.predictions.where(F.col("scored_at") < F.lit("2000-01-01").cast("timestamp_ntz"))
    cached = decisions.latest_prediction(old)
    scorer = model.logistic_scorer(WEIGHTS, intercept=-0.2, version="live")
    return model.score_missing(gl.scoring, cached, scorer)


def _given_parts(gl: GivenLake) -> DataFrame:
    return drivers.linear_contributions(gl.scored_once, WEIGHTS)


@query
def linear_drivers(gl: GivenLake) -> DataFrame:
    return drivers.ranked_drivers(_given_parts(gl), list(WEIGHTS))


@query
def driver_explanation(gl: GivenLake) -> DataFrame:
    return drivers.explanation_rows(_given_parts(gl), list(WEIGHTS))


def _given_driver_lists(gl: GivenLake) -> DataFrame:
    return drivers.driver_lists(_given_parts(gl), list(WEIGHTS))


@query
def driver_narrative(gl: GivenLake) -> DataFrame:
    return drivers.driver_narrative(_given_driver_lists(gl))


@query
def driver_text(gl: GivenLake) -> DataFrame:
    return drivers.driver_text(_given_driver_lists(gl))


@query
def pd_scores(gl: GivenLake) -> DataFrame:
    """Fit on the labelled applications, score all of them."""
    return model.score(gl.scoring, gl.trained.model, "v1", _LANDED_AT)


@query
def model_metrics(gl: GivenLake) -> DataFrame:
    run = gl.trained
    rows = [(m, v) for m, v in run.metrics.items()]
    sizes = [("train_rows", float(run.train_rows)), ("test_rows", float(run.test_rows))]
    return gl.spark.createDataFrame(rows + sizes, "metric string, value double")


@query
def cv_auc(gl: GivenLake) -> DataFrame:
    """Forest AUC on each of five stratified folds."""
    found = model.cross_validate(gl.training, model.VERSIONED, parallel=5)
    rows = [(f"fold {i}", auc) for i, auc in enumerate(found["folds"])]
    rows += [("mean", found["mean"]), ("std", found["std"])]
    return gl.spark.createDataFrame(rows, "fold string, auc double")


@query
def risk_drivers(gl: GivenLake) -> DataFrame:
    """Forest drivers of every application by Shapley value."""
    fitted = gl.trained.model
    parts = drivers.tree_contributions(gl.scoring, fitted)
    return drivers.ranked_drivers(parts, fitted.spec.columns)


@query
def path_drivers(gl: GivenLake) -> DataFrame:
    """Forest drivers of every application by decision path."""
    fitted = gl.trained.model
    parts = drivers.tree_contributions(gl.scoring, fitted, method="path")
    return drivers.ranked_drivers(parts, fitted.spec.columns)


@query
def attribution_sums(gl: GivenLake) -> DataFrame:
    """Whether base value and contributions add up to the forest's probability, both ways."""
    fitted = gl.trained.model
    base = drivers.base_value(drivers.forest_table(fitted.rf))
    scores = model.predict(gl.scoring, fitted).select("application_id", "pd_probability_rf")

    def adds_up(method: str) -> DataFrame:
        parts = drivers.tree_contributions(gl.scoring, fitted, method)
        total = F.aggregate("contributions", F.lit(base), lambda a, x: a + x)
        gap = F.abs(total - F.col("pd_probability_rf"))
        return parts.join(scores, "application_id").select(
            "application_id", F.lit(method).alias("method"), (gap < 1e-9).alias("adds_up")
        )

    return adds_up("shapley").unionByName(adds_up("path"))


@query
def pd_scores_full(gl: GivenLake) -> DataFrame:
    """The main training profile: more trees, deeper, with the category features."""
    return model.score(gl.scoring, gl.trained_full, "full", _LANDED_AT)


@query
def risk_drivers_full(gl: GivenLake) -> DataFrame:
    """Drivers of every application by Shapley value under the main training profile."""
    fitted = gl.trained_full
    return drivers.ranked_drivers(drivers.tree_contributions(gl.scoring, fitted), fitted.spec.columns)


@query
def explanations(gl: GivenLake) -> DataFrame:
    found = drivers.explain_applications(gl.scoring, gl.trained.model)
    return found.withColumn("top_drivers", F.to_json("top_drivers"))


# --------------------------------------------------------------------------- retrieval


@query
def chunk_documents(gl: GivenLake) -> DataFrame:
    return gl.chunks.select("id", "text", "metadata.*")


@query
def chunk_stats(gl: GivenLake) -> DataFrame:
    return retrieval.chunk_stats(gl.chunks)


@query
def vector_topk(gl: GivenLake) -> DataFrame:
    """For every label the vectors nearest to the label's mean vector."""
    vectors = gl.table("embeddings")
    topics = retrieval.centroids(vectors, "label").withColumnRenamed("label", "query_id")
    return retrieval.vector_topk(topics, vectors).withColumn("distance", F.round("distance", 4))


@query
def vector_search(gl: GivenLake) -> DataFrame:
    """The ten vectors nearest to each twentieth vector, itself included."""
    vectors = gl.table("embeddings")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    hits, _ = vector_index.search(vector_index.build_index(vectors), asked, 10)
    return hits.withColumnRenamed("vector_id", "vec_id").withColumn("distance", F.round("distance", 4))


@query
def tfidf_topk(gl: GivenLake) -> DataFrame:
    """Nearest chunks of every user question, over all chunks of all documents."""
    return gl.question_hits.withColumn("distance", F.round("distance", 4))


@query
def term_frequencies(gl: GivenLake) -> DataFrame:
    """In how many chunks each term stands: over one half of the documents, then changed by the
    other half and by what leaves."""
    number = F.col("metadata.source").cast("bigint")
    old, added, removed = (
        term_index.frequencies(term_index.counted(gl.chunks.where(part)))
        for part in (number % 2 == 0, number % 2 == 1, number % 10 == 0)
    )
    merged = term_index.merged_frequencies(old, added, removed)
    return merged.groupBy(F.col("n").alias("chunks")).agg(F.count("*").alias("terms"))


def _cited(gl: GivenLake) -> DataFrame:
    """Passages that each question hit, with where they stand."""
    passages = gl.chunks.select(
        "id", "text", "metadata.source", "metadata.filename", "metadata.section", "metadata.chunk_index"
    )
    return retrieval.cited_hits(gl.question_hits, passages, vector_id="id")


@query
def cited_sources(gl: GivenLake) -> DataFrame:
    return _cited(gl).select(
        "query_id", "rank", "source", "filename", "section", "chunk_index", "excerpt", "distance"
    )


@query
def cited_context(gl: GivenLake) -> DataFrame:
    return retrieval.context_blocks(_cited(gl))


def _application_context(gl: GivenLake) -> DataFrame:
    texts = drivers.driver_text(_given_driver_lists(gl))
    return write_stage(retrieval.application_context(gl.decided, texts), "application_context")


@query
def analyst_prompts(gl: GivenLake) -> DataFrame:
    """Every user question with the passages that it hit itself."""
    contexts = write_stage(retrieval.context_blocks(_cited(gl)), "contexts")
    return retrieval.prompt_rows(gl.questions, contexts, _application_context(gl))


@query
def assessment_questions(gl: GivenLake) -> DataFrame:
    """The standing question for every scored application, searched for by its own text."""
    scored = gl.predictions.select("application_id").distinct()
    return retrieval.assessment_questions(scored, F.col("application_id"))
