"""The daily run: land, build silver, check, train, register, score, explain, watch for drift."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import (
    drift,
    drivers,
    model,
    monthly_state,
    quality,
    registry,
    training_set,
)
from creditloom.operators.latest import upsert
from creditloom.plans.silver import Silver
from creditloom.session import configure, side_by_side, stages_of_run, write_stage
from creditloom.sources import audit, landing
from creditloom.sources.snapshots import (
    known_table,
    read_parts,
    read_table,
    replace_part,
    update_part,
)

PREDICTION_KEYS = ["application_id", "model_version"]
MONITORING_KEYS = ["model_version", "snapshot_date"]


@dataclass
class LakePaths:
    """Folders of the tables of a lake."""

    base: str

    def __getattr__(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"


@dataclass
class PipelineResult:
    version: str
    metrics: dict[str, float]
    status: str
    drift: dict
    #: Sources whose columns or types differ from the landing before: source -> the change.
    schema_changes: dict[str, dict] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def _merge(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    keys: list[str],
    columns: list[str] | None = None,
    part: str = "all",
) -> None:
    """Upsert rows into a part of a keyed table; the part is replaced by a new snapshot."""

    def merged(old: DataFrame | None) -> DataFrame:
        return rows if old is None else upsert(old.select(*rows.columns), rows, keys, columns)

    update_part(spark, path, merged, part)


# --------------------------------------------------------------------------- steps


def land_source(
    spark: SparkSession, source: str, raw_dir: str, paths: LakePaths, run_id: str, day: dt.date
) -> None:
    """Land one source and log it; a failure is logged and raised."""

    def log(status: str, **details) -> None:
        event = audit.audit_event(spark, run_id, source, day, status, **details)
        audit.append_audit(event, paths.audit_log, source)

    log("running")
    try:
        file = f"{raw_dir.rstrip('/')}/{landing.SOURCES[source]}"
        raw = landing.read_source(spark, source, file)
        landed_at = dt.datetime.now()
        rows = landing.with_ingest_metadata(raw, day, landed_at, source_file=file)
        path = landing.write_bronze(rows, paths.bronze, source, day)
        day_rows = landing.read_bronze(spark, paths.bronze, source, day)
        profile = audit.profile_ingest(day_rows, source).first()
        size = audit.file_bytes(day_rows).first()
        snapshot = audit.schema_snapshot(day_rows, source, F.lit(day))
        audit.write_snapshot(snapshot, paths.schema_snapshots, source, day)
        log(
            "success",
            row_count=profile["row_count"],
            file_size_bytes=size["file_size_bytes"],
            column_names=profile["column_names"],
            column_dtypes=profile["column_dtypes"],
            row_hash=profile["row_hash"],
            parquet_path=path,
        )
    except Exception as e:
        log("failed", error_message=str(e))
        raise


def land(
    spark: SparkSession, raw_dir: str, paths: LakePaths, run_id: str, day: dt.date
) -> None:
    """Land all sources side by side; they do not depend on each other."""
    side_by_side(
        *[
            partial(land_source, spark, s, raw_dir, paths, run_id, day)
            for s in landing.SOURCES
        ]
    )


def schema_changes(spark: SparkSession, paths: LakePaths, day: dt.date) -> dict[str, dict]:
    """What changed in the columns of each source since the landing before that of ``day``."""
    compared = audit.schema_drift(spark.read.parquet(paths.schema_snapshots))
    today = compared.where((F.col("snapshot_date") == F.lit(day)) & F.col("changed"))
    listed = ("added", "removed", "retyped")
    return {r["source_name"]: {c: r[c] for c in listed} for r in today.collect()}


def check_bronze(spark: SparkSession, paths: LakePaths, run_id: str, day: dt.date) -> None:
    """Keep the results of the checks of what was landed on ``day``.

    Sources may be dirty and staging cleans them, so only the silver suite stops a run.
    """
    tables = {s: landing.read_bronze(spark, paths.bronze, s, day) for s in landing.SOURCES}
    checks = [*quality.BRONZE_CHECKS, *quality.MACRO_CHECKS]
    results = write_stage(quality.run_suite(tables, checks), "bronze-checks")
    stamp = {"run_id": F.lit(run_id), "execution_date": F.lit(day)}
    results.withColumns(stamp).coalesce(1).write.mode("append").parquet(paths.check_results)


def build_silver(
    spark: SparkSession, paths: LakePaths, as_of: dt.date, day: dt.date
) -> Silver:
    """All four silver tables, rebuilt from the extract of ``day`` or all increments.

    Each is replaced by a snapshot: if the run dies, readers have the table before.  Of
    transactions that land as increments only those of ``day`` are read; the other days have left
    their monthly state.
    """

    def write(df: DataFrame, name: str) -> DataFrame:
        path = f"{paths.silver}/{name}"
        replace_part(df, path)
        return read_parts(spark, path).select(*df.columns)

    loans, bureau, transactions = (
        landing.read_extract(spark, paths.bronze, s, day)
        for s in ("loan_applications", "credit_bureau", "transactions")
    )
    monthly = None
    if landing.LANDING["transactions"] == landing.INCREMENT:
        landed = landing.read_bronze(spark, paths.bronze, "transactions", day)
        monthly_state.keep_state(landed, paths.monthly_state, day)
        states = monthly_state.kept_states(spark, paths.monthly_state)
        monthly = monthly_state.spend_of_states(states, as_of)
    silver = Silver(loans, bureau, transactions, as_of, write, monthly)
    silver.tables()
    return silver


def check_silver(silver: Silver, paths: LakePaths, run_id: str, day: dt.date) -> None:
    """Run the suite, keep its results and a summary, and stop when a check failed."""
    tables = silver.tables()
    results = write_stage(quality.run_suite(tables, quality.SILVER_CHECKS), "checks")
    stamp = {"run_id": F.lit(run_id), "execution_date": F.lit(day)}
    results.withColumns(stamp).coalesce(1).write.mode("append").parquet(paths.check_results)
    summary = quality.run_summary(results, models_run=len(tables)).withColumns(
        {**stamp, "completed_at": F.current_timestamp()}
    )
    summary.coalesce(1).write.mode("append").parquet(paths.pipeline_runs)
    quality.require_pass(results)


def register_run(
    spark: SparkSession, paths: LakePaths, run: model.TrainingRun, version: str, promote: bool
) -> str:
    """Add a training run to the registry and return its status."""
    row = {
        "model_version": version,
        **run.metrics,
        "feature_count": run.feature_count,
        "train_rows": run.train_rows,
        "test_rows": run.test_rows,
        "status": None,
        "trained_at": dt.datetime.now(),
        "registered_at": dt.datetime.now(),
        "notes": None,
    }
    names = [c.split()[0] for c in registry.REGISTRY_SCHEMA.split(", ")]
    entry = spark.createDataFrame([tuple(row[c] for c in names)], registry.REGISTRY_SCHEMA)

    def registered(table: DataFrame | None) -> DataFrame:
        if table is None:
            table = spark.createDataFrame([], registry.REGISTRY_SCHEMA)
        return registry.register(table, entry, promote)

    update_part(spark, paths.model_registry, registered)
    return registry.get_model(known_table(spark, paths.model_registry), version).first()["status"]


def write_scores(spark: SparkSession, paths: LakePaths, scores: DataFrame, version: str) -> None:
    """Upsert the scores of one version; only the part of that version is replaced."""
    _merge(spark, scores, paths.pd_predictions, PREDICTION_KEYS, part=version)


def write_drivers(
    paths: LakePaths, frame: DataFrame, run: model.TrainingRun, version: str
) -> None:
    """Strongest forest drivers of every scored application."""
    parts = drivers.tree_contributions(frame, run.model)
    ranked = drivers.ranked_drivers(parts, run.model.spec.columns).withColumns(
        {"model_version": F.lit(version), "computed_at": F.current_timestamp()}
    )
    replace_part(ranked, paths.shap_values, version)


def read_drivers(
    spark: SparkSession, paths: LakePaths, application_id: str, version: str, n: int = 10
) -> DataFrame:
    """The n strongest drivers of an application under a version, strongest first."""
    rows = read_parts(spark, paths.shap_values, version)
    if rows is None:
        raise LookupError(f"no drivers of version {version}")
    found = rows.where((F.col("application_id") == application_id) & (F.col("rank") <= n))
    return found.orderBy("rank")


def run_pipeline(
    spark: SparkSession,
    raw_dir: str,
    lake_dir: str,
    run_id: str,
    execution_date: dt.date,
    as_of: dt.date | None = None,
    version: str | None = None,
    profile: model.Profile = model.VERSIONED,
    promote: bool = True,
    min_auc: float = registry.MIN_AUC,
) -> PipelineResult:
    """One complete run over the files in ``raw_dir``; tables are kept under ``lake_dir``."""
    configure(spark)
    with stages_of_run(spark):
        return _run(
            spark, raw_dir, LakePaths(lake_dir), run_id, execution_date, as_of or execution_date,
            version or f"v{dt.datetime.now():%Y%m%d_%H%M%S}", profile, promote, min_auc,
        )


def _run(
    spark: SparkSession,
    raw_dir: str,
    paths: LakePaths,
    run_id: str,
    execution_date: dt.date,
    as_of: dt.date,
    version: str,
    profile: model.Profile,
    promote: bool,
    min_auc: float,
) -> PipelineResult:
    seconds: dict[str, float] = {}

    def timed(name: str, step: Callable):
        start = time.perf_counter()
        out = step()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    timed("land", lambda: land(spark, raw_dir, paths, run_id, execution_date))
    changes, _, silver = side_by_side(
        lambda: timed("schema", lambda: schema_changes(spark, paths, execution_date)),
        lambda: timed("bronze_checks", lambda: check_bronze(spark, paths, run_id, execution_date)),
        lambda: timed("silver", lambda: build_silver(spark, paths, as_of, execution_date)),
    )

    def prepare_and_train() -> tuple[DataFrame, model.TrainingRun]:
        frame = training_set.scoring_frame(silver.feat_dti_ratio, silver.feat_credit_util)
        frame = timed("frame", lambda: write_stage(frame, "scoring_frame"))
        labelled = frame.where(F.col(training_set.LABEL).isNotNull())
        return frame, timed("train", lambda: model.train(labelled, profile))

    # a fit leaves nothing in the lake, so it need not wait for the checks
    _, (frame, run) = side_by_side(
        lambda: timed("checks", lambda: check_silver(silver, paths, run_id, execution_date)),
        prepare_and_train,
    )
    registry.gate(run.metrics["ensemble_auc"], min_auc)
    scores = model.score(frame, run.model, version)

    def watch() -> dict:
        predictions = read_table(spark, paths.pd_predictions)
        found = drift.drift_snapshot(predictions, execution_date)
        row = found.first()
        snapshot = spark.createDataFrame([row], found.schema)
        columns = drift.SNAPSHOT_UPDATES
        _merge(spark, snapshot, paths.model_monitoring, MONITORING_KEYS, columns)
        return row.asDict()

    def score_and_watch() -> dict:
        timed("score", lambda: write_scores(spark, paths, scores, version))
        return timed("drift", watch)

    status, found, *_ = side_by_side(
        lambda: timed("register", lambda: register_run(spark, paths, run, version, promote)),
        score_and_watch,
        lambda: timed("drivers", lambda: write_drivers(paths, frame, run, version)),
        lambda: timed("save", lambda: run.model.save(f"{paths.models}/{version}")),
    )
    return PipelineResult(version, run.metrics, status, found, changes, seconds)
