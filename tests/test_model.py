import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import bench
from creditloom.operators import drivers, model, quality, registry
from creditloom.plans import pipeline
from creditloom.plans.given_lake import lake
from creditloom.session import shared_folder, stage_path
from creditloom.sources import audit, given_tables
from creditloom.sources.snapshots import read_parts, read_table, replace_part

SMALL = model.Profile(
    model.VERSIONED.numeric, model.VERSIONED.categorical, trees=6, depth=4, min_leaf=2
)


@pytest.fixture(scope="module")
def run(spark, sf):
    return model.train(lake(spark, sf).training, SMALL)


def test_training(spark, sf, run):
    n = lake(spark, sf).training.count()
    assert run.train_rows == int(n * 0.8) and run.train_rows + run.test_rows == n
    assert run.feature_count == 22
    assert all(0.7 <= v <= 1.0 for v in run.metrics.values())
    registry.gate(run.metrics["ensemble_auc"])


def test_scores(spark, sf, run):
    scores = model.score(lake(spark, sf).scoring, run.model, "v1", dt.datetime(2024, 1, 1))
    assert scores.columns == model.SCORE_COLUMNS
    assert scores.count() == lake(spark, sf).scoring.count()
    bad = scores.where(
        (F.abs(0.7 * F.col("pd_probability_rf") + 0.3 * F.col("pd_probability_lr")
               - F.col("pd_probability_ens")) > 1e-12)
        | ~F.col("pd_probability_ens").between(0, 1)
        | (F.col("pd_prediction") != (F.col("pd_probability_ens") >= 0.5).cast("int"))
    )
    assert bad.count() == 0


def test_saved_model_scores_the_same(spark, sf, run):
    path = stage_path(spark, "model")
    run.model.save(path)
    frame = lake(spark, sf).scoring
    again = model.predict(frame, model.PdModel.load(path))
    both = model.predict(frame, run.model).exceptAll(again)
    assert both.count() == 0


@pytest.mark.parametrize("method", ["shapley", "path"])
def test_forest_contributions_add_up(spark, sf, run, method):
    frame = lake(spark, sf).scoring
    parts = drivers.tree_contributions(frame, run.model, method)
    base = drivers.base_value(drivers.forest_table(run.model.rf))
    total = F.aggregate("contributions", F.lit(base), lambda a, x: a + x)
    scores = model.predict(frame, run.model).select("application_id", "pd_probability_rf")
    gap = parts.join(scores, "application_id").agg(
        F.max(F.abs(total - F.col("pd_probability_rf")))
    )
    assert gap.first()[0] < 1e-9


def test_regression_contributions_add_up(spark, sf, run):
    """Contributions differ between two rows exactly as their log-odds do."""
    encoded = model.encode(lake(spark, sf).scoring, run.model.spec, keep=["application_id", "customer_id"])
    weights = drivers.regression_weights(run.model)
    parts = drivers.linear_contributions(encoded, weights)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    scores = model.predict(lake(spark, sf).scoring, run.model)
    p = F.col("pd_probability_lr")
    joined = parts.join(scores, "application_id").where(p.between(0.001, 0.999))
    gaps = joined.select((F.log(p / (1 - p)) - total).alias("g")).agg(F.min("g"), F.max("g")).first()
    assert gaps[1] - gaps[0] < 1e-6
    assert gaps[0] == pytest.approx(run.model.lr.intercept, abs=1e-6)


def test_ranked_drivers(spark):
    df = spark.createDataFrame(
        [("A", "C", [1.0, 2.0, 3.0, 4.0], [0.1, -0.5, 0.1, 0.0])],
        "application_id string, customer_id string, values array<double>, "
        "contributions array<double>",
    )
    names = ["f_a", "f_b", "f_c", "f_d"]
    got = drivers.ranked_drivers(df, names).orderBy("rank").collect()
    assert [(r["rank"], r.feature_name, r.direction, r.label) for r in got] == [
        (1, "f_b", "decreases_risk", "f b"),
        (2, "f_a", "increases_risk", "f a"),
        (3, "f_c", "increases_risk", "f c"),
        (4, "f_d", "decreases_risk", "f d"),
    ]
    shown = drivers.explanation_rows(df, names).orderBy("rank").collect()
    assert [r.feature_name for r in shown] == ["f_b", "f_a", "f_c"]
    assert shown[0].direction == "reduces_risk"
    lists = drivers.driver_lists(df, names, 10, 5, drivers.MIN_CONTRIBUTION, drivers.REDUCES)
    text = drivers.driver_narrative(lists).first().narrative
    assert text == (
        "The primary factors increasing default risk are: f a (1.0), f c (3.0). "
        "Protective factors include: f b (2.0)."
    )
    first = lists.withColumn("drivers", F.slice("drivers", 1, 1))
    none = drivers.driver_narrative(first).first()
    assert "are: no dominant risk factors." in none.narrative


def test_drivers_are_rounded_as_columns_not_as_array_elements(spark):
    df = spark.createDataFrame(
        [("A", "C", [1.0], [0.1])],
        "application_id string, customer_id string, values array<double>, "
        "contributions array<double>",
    )
    ranked = drivers.ranked_drivers(df, ["f_a"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Generate posexplode" in line for line in plan)
    assert not any("Generate" in line and "format_number" in line for line in plan)


def test_cross_validation(spark, sf):
    tiny = model.Profile(SMALL.numeric, SMALL.categorical, trees=4, depth=4)
    out = model.cross_validate(lake(spark, sf).training, tiny, k=3, parallel=3)
    assert len(out["folds"]) == 3 and min(out["folds"]) > 0.7
    assert out["std"] == pytest.approx(np.std(out["folds"]))


def test_scoring_only_what_is_missing(spark, sf, run):
    frame = lake(spark, sf).scoring
    old = model.score(frame.where("loan_term_months = 12"), run.model, "v0")
    out = model.score_missing(frame, old, lambda f: model.score(f, run.model, "v1"))
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["cache"] == old.count()
    assert sum(counts.values()) == frame.count() == out.select("application_id").distinct().count()


def test_pipeline(spark, sf, tmp_path):
    raw, base = bench.write_raw_files(spark, sf), str(tmp_path / "lake")
    paths = pipeline.LakePaths(base)

    def go(day, version):
        return pipeline.run_pipeline(
            spark, raw, base, f"run-{day}", dt.date(2024, 1, day), given_tables.AS_OF,
            version=version, profile=SMALL,
        )

    first = go(1, "v1")
    assert first.status == "active" and first.drift["drift_severity"] == "none"
    assert first.schema_changes == {}
    n = read_table(spark, paths.pd_predictions).count()
    names = ("stg_loans", "stg_credit", "feat_dti_ratio", "feat_credit_util")

    def silver():
        stamps = ("silver_processed_at", "feature_computed_at")
        return {t: sorted(map(str, read_table(spark, f"{paths.silver}/{t}").drop(*stamps).collect()))
                for t in names}

    once = silver()
    second = go(2, "v2")
    assert second.status == "candidate" and second.schema_changes == {}
    assert silver() == once  # the same files again count once
    go(2, "v2")  # a repeated run adds nothing
    assert read_table(spark, paths.pd_predictions).count() == 2 * n
    assert read_table(spark, paths.model_registry).count() == 2
    assert read_table(spark, paths.model_monitoring).count() == 2
    explained = read_table(spark, paths.shap_values)
    assert explained.select("application_id", "model_version").distinct().count() == 2 * n
    someone = explained.first().application_id
    top = pipeline.read_drivers(spark, paths, someone, "v1", 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3]
    assert {r.application_id for r in top} == {someone}
    stages = Path(shared_folder(spark).removeprefix("file://")) / "creditloom"
    assert not list(stages.glob(f"{spark.sparkContext.applicationId}/run-*/*"))
    state = audit.latest_audit(spark.read.parquet(paths.audit_log))
    assert {(r.status, r.source_name) for r in state.collect()} == {
        ("success", s) for s in pipeline.landing.SOURCES
    }
    shap = read_table(spark, paths.shap_values)
    assert shap.select("application_id", "rank").distinct().count() * 2 == shap.count()
    snapshots = spark.read.parquet(paths.schema_snapshots)
    assert snapshots.count() == 2 * len(pipeline.landing.SOURCES)
    assert audit.schema_drift(snapshots).where("changed").count() == 0

    # a failing check stops the run and is recorded
    loans = spark.read.option("header", True).csv(f"{raw}/loan_applications.csv")
    broken = loans.withColumn("employment_type", F.lit("astronaut"))
    other = bench.write_raw_files(spark, sf)
    broken.coalesce(1).write.mode("overwrite").option("header", True).csv(
        f"{other}/loan_applications.csv"
    )
    with pytest.raises(quality.QualityError, match="employment_type"):
        pipeline.run_pipeline(
            spark, other, str(tmp_path / "bad"), "run-x", dt.date(2024, 1, 1),
            given_tables.AS_OF, profile=SMALL,
        )
    runs = spark.read.parquet(str(tmp_path / "bad" / "pipeline_runs")).first()
    assert (runs.status, runs.tests_failed) == ("partial", 1)


def test_failed_landing_is_logged(spark, tmp_path):
    paths = pipeline.LakePaths(str(tmp_path / "lake"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pipeline.land_source(
            spark, "transactions", str(tmp_path), paths, "r", dt.date(2024, 1, 1)
        )
    row = audit.latest_audit(spark.read.parquet(paths.audit_log)).first()
    assert row.status == "failed" and "PATH_NOT_FOUND" in row.error_message


def test_explanations(spark, sf, run):
    frame = lake(spark, sf).scoring
    rows = drivers.explain_applications(frame, run.model)
    assert rows.count() == frame.count()
    row = rows.first()
    strengths = [abs(d.shap_value) for d in row.top_drivers]
    assert len(strengths) <= 10 and strengths == sorted(strengths, reverse=True)
    assert row.narrative.startswith("The primary factors increasing default risk are: ")
    assert row.pd_label in ("LOW", "MEDIUM", "HIGH", "VERY HIGH")


def test_the_forest_does_not_depend_on_the_layout(spark, sf):
    frame = lake(spark, sf).training
    found = []
    for parts in (2, 4, 16):
        fitted = model.fit(frame.repartition(parts), SMALL)
        scores = model.predict(frame, fitted).select("application_id", "pd_probability_ens")
        found.append({r.application_id: round(r.pd_probability_ens, 9) for r in scores.collect()})
    assert found[0] == found[1] == found[2]


def test_plans_of_explanations_shuffle_nothing(spark, sf, run):
    frame = lake(spark, sf).scoring
    out = drivers.explain_applications(frame, run.model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Join" not in plan


def _land(spark, tmp_path, paths, day, header, rows):
    raw = tmp_path / f"raw{day}"
    raw.mkdir()
    (raw / "macro_indicators.csv").write_text("\n".join([header, *rows]) + "\n")
    on = dt.date(2024, 1, day)
    pipeline.land_source(spark, "macro_indicators", str(raw), paths, f"run-{day}", on)
    return on


def test_columns_that_change_between_days(spark, tmp_path):
    """One column comes, one goes and one holds another type; the history has them all."""
    paths = pipeline.LakePaths(str(tmp_path / "lake"))
    _land(spark, tmp_path, paths, 1, "date,cpi_inflation_pct,note", ["2024-01-01,5.5,7", "2024-01-02,5.6,8"])
    day = _land(spark, tmp_path, paths, 2, "date,note,extra", ["2024-01-03,x,1"])
    assert pipeline.schema_changes(spark, paths, day) == {
        "macro_indicators": {"added": ["extra"], "removed": ["cpi_inflation_pct"], "retyped": ["note"]}
    }
    second = pipeline.landing.read_bronze(spark, paths.bronze, "macro_indicators", day)
    assert [c for c in second.columns if not c.startswith("_")] == ["date", "note", "extra"]
    history = pipeline.landing.read_bronze(spark, paths.bronze, "macro_indicators")
    rows = {str(r.date): (r.cpi_inflation_pct, r.note, r.extra) for r in history.collect()}
    assert rows == {
        "2024-01-01": (5.5, "7", None), "2024-01-02": (5.6, "8", None), "2024-01-03": (None, "x", "1"),
    }
    log = audit.latest_audit(spark.read.parquet(paths.audit_log)).where("run_id = 'run-2'").first()
    assert log.row_count == 1 and "cpi_inflation_pct" not in log.column_names


def test_a_table_survives_a_writer_that_dies(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert read_table(spark, path) is None
    replace_part(spark.range(3), path)
    boom = spark.range(4).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        replace_part(boom, path)
    assert read_table(spark, path).count() == 3
    for n in (5, 6, 7):
        replace_part(spark.range(n), path)
        replace_part(spark.range(1), path, "other")
    assert read_table(spark, path).count() == 8 and read_parts(spark, path, "all").count() == 7
    assert len(list((tmp_path / "table" / "all").glob("snapshot-*"))) <= 3
    with pytest.raises(ValueError, match="cannot be called"):
        replace_part(spark.range(1), path, "a/b")


def test_all_ids_of_a_batch_are_read(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("application_id\n" + "".join(f"A{i}\n" for i in range(1000)))
    assert pipeline.landing.read_ids(spark, str(tmp_path / "ids.csv")).count() == 1000


def test_too_many_classes(spark):
    from creditloom.operators import training_set

    df = spark.range(training_set.MAX_LEVELS + 1).withColumnRenamed("id", "default_flag")
    with pytest.raises(ValueError, match="classes"):
        training_set.class_counts(df)


def test_repeated_keys_are_an_error(spark):
    from creditloom.operators.latest import upsert

    once = spark.createDataFrame([("a", 1)], "k string, v int")
    twice = spark.createDataFrame([("b", 1), ("b", 2)], "k string, v int")
    for pair in ((once, twice), (twice, once)):
        with pytest.raises(Exception, match="repeated key"):
            upsert(*pair, ["k"]).collect()


def test_tasks_of_a_fit_do_not_grow_with_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(model, "_ROWS_PER_TASK", 3)
    monkeypatch.setattr(model, "_MOST_TASKS", 7)
    training = lake(spark, sf).training
    _, laid_out, rows = model._encoded(training, SMALL, "few_tasks")
    laid = laid_out(rows)
    assert laid.rdd.getNumPartitions() == 7
    assert laid.count() == training.count()


def test_folds_leave_nothing_behind_and_go_one_by_one_if_large(spark, sf, monkeypatch):
    """Each fold's rows are deleted when it is done, and large folds are not fitted side by side."""
    frame = lake(spark, sf).training
    together = model.cross_validate(frame, SMALL, k=3, parallel=3)
    written, open_folds, most, write = {}, set(), [], model.write_stage

    def watched(df, name):
        out = write(df, name)
        if name == "fold_rows":
            path = out.inputFiles()[0]
            open_folds.difference_update({p for p in open_folds if not Path(p.removeprefix("file:" + "//")).exists()})
            open_folds.add(path)
            most.append(len(open_folds))
        written[name] = out.inputFiles()
        return out

    monkeypatch.setattr(model, "write_stage", watched)
    monkeypatch.setattr(model, "_ROWS_AT_ONCE", 1)
    assert model.cross_validate(frame, SMALL, k=3, parallel=3) == together
    assert max(most) == 1
    assert not any(Path(p.removeprefix("file:" + "//")).exists() for p in written["fold_rows"])
    assert set(spark.read.parquet(written["folds"][0]).columns) == {
        "application_id", "default_flag", "fold", *SMALL.numeric, *SMALL.categorical
    }
