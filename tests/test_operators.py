"""Quality, decisions, registry, audit and landing on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.operators import decisions, features, quality, registry, staging
from creditloom.sources import audit, landing

# --------------------------------------------------------------------------- quality


def test_suite_finds_each_kind_of_failure(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 5), (None, None, None)], "id string, kind string, n int"
    )
    checks = quality._checks(
        "t", {"id": ["unique", "not_null"], "kind": [["x"]], "n": [(0, 3), "not_null"]}
    )
    got = {
        (r.column_name, r.check_kind): (r.failures, r.status)
        for r in quality.run_suite({"t": df}, checks).collect()
    }
    assert got == {
        ("id", "unique"): (1, "fail"),
        ("id", "not_null"): (1, "fail"),
        ("kind", "accepted_values"): (1, "fail"),
        ("n", "accepted_range"): (1, "fail"),
        ("n", "not_null"): (1, "fail"),
    }
    results = quality.run_suite({"t": df}, checks)
    assert quality.run_summary(results, 1).first().asDict() == {
        "models_run": 1, "tests_passed": 0, "tests_failed": 5, "status": "partial",
    }
    with pytest.raises(quality.QualityError, match="t.id:unique"):
        quality.require_pass(results)
    assert quality.failing_values(df, checks[2]).collect() == [("y", 1)]


def test_row_checks_share_one_aggregate(spark):
    df = spark.range(5).select(F.col("id").alias("a"), F.col("id").alias("b"))
    checks = quality._checks("t", {"a": ["not_null", (0, 9)], "b": ["not_null", [0, 1, 2, 3, 4]]})
    out = quality.run_suite({"t": df}, checks)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    quality.require_pass(out)


def test_a_table_with_a_unique_key_is_read_once(spark):
    """Null and repeated keys; an empty table counts as 0."""
    rows = [("a", 1), ("a", None), ("b", None), (None, 2), (None, None)]
    df = spark.createDataFrame(rows, "id string, n int")
    checks = quality._checks("t", {"id": ["unique", "not_null"], "n": ["not_null", (2, 9)]})
    out = quality.run_suite({"t": df}, checks)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    failures = {(r.column_name, r.check_kind): r.failures for r in out.collect()}
    assert failures == {
        ("id", "unique"): 1, ("id", "not_null"): 2, ("n", "not_null"): 3, ("n", "accepted_range"): 1,
    }
    assert [r.failures for r in quality.run_suite({"t": df.limit(0)}, checks).collect()] == [0] * 4
    twice = quality._checks("t", {"id": ["unique"], "n": ["unique"]})
    assert [r.failures for r in quality.run_suite({"t": df}, twice).collect()] == [1, 0]


def test_there_are_28_silver_checks():
    kinds = [c.kind for c in quality.SILVER_CHECKS]
    assert len(kinds) == 28
    assert [kinds.count(k) for k in ("not_null", "unique", "accepted_values")] == [14, 4, 10]


# --------------------------------------------------------------------------- staging


def test_staging_dedup_and_rejects(spark):
    cols = (
        "application_id string, customer_id string, application_date string, "
        "loan_amount_inr string, annual_income_inr string, loan_term_months string, "
        "existing_loans string, collateral_value string, credit_score string, "
        "employment_type string, loan_purpose string, default_flag string, "
        "_bronze_ingested_at timestamp"
    )
    at = dt.datetime(2024, 1, 1)

    def loan(app, income="1000", day="2023-01-01", amount="500", when=at, cust="C1"):
        return (app, cust, day, amount, income, "12", "0", "100", "700", " Salaried",
                "AUTO ", "1", when)

    rows = [
        loan(" A1", amount="1"),
        loan("A1 ", amount="2", when=at + dt.timedelta(days=1), day="2022-01-01"),
        loan("A2", income="0"),
        loan(None),
        loan("A3", cust=None),
        loan("A4", amount="0"),
    ]
    out = {r.application_id: r for r in staging.stg_loans(spark.createDataFrame(rows, cols)).collect()}
    assert sorted(out) == ["A1", "A4"]
    # the later ingest wins over the later application date
    assert out["A1"].loan_amount_inr == 2
    assert out["A1"].employment_type == "salaried" and out["A1"].loan_purpose == "auto"
    assert out["A4"].collateral_coverage_ratio is None and out["A4"].loan_to_income_ratio == 0.0


def test_undated_pull_wins_and_null_utilisation_is_maxed_out(spark):
    cols = (
        "customer_id string, bureau_pull_date string, credit_score string, "
        "total_accounts string, open_accounts string, delinquent_accounts string, "
        "credit_utilisation_pct double, oldest_account_months string, "
        "hard_inquiries_6m string, total_credit_limit_inr string, total_balance_inr string"
    )
    rows = [
        ("C1", "2024-01-01", "700", "4", "1", "1", 0.5, "20", "1", "100", "300"),
        ("C1", None, "650", "0", "1", "1", None, None, "3", None, "300"),
    ]
    row = staging.stg_credit(spark.createDataFrame(rows, cols)).first()
    assert row.credit_score == 650
    assert (row.credit_utilisation_pct, row.utilisation_band) == (1.0, "maxed_out")
    assert (row.delinquency_rate, row.available_credit_inr) == (0.0, 0)
    assert (row.high_inquiry_flag, row.credit_age_band) == (1, "mature")


def _loan_and_credit(spark, emi_loan, burden_balance, income, util=0.3, limit=100):
    loans = spark.createDataFrame(
        [("A", "C", dt.date(2024, 1, 1), income, emi_loan, 100, 0, "x", "x", 700, 0.1, 0.1, "low", 0)],
        "application_id string, customer_id string, application_date date, "
        "annual_income_inr bigint, loan_amount_inr bigint, loan_term_months int, "
        "existing_loans int, employment_type string, loan_purpose string, credit_score int, "
        "loan_to_income_ratio double, collateral_coverage_ratio double, "
        "credit_risk_tier string, default_flag int",
    )
    credit = spark.createDataFrame(
        [("C", dt.date(2024, 1, 1), 700, burden_balance, limit, util, 0, 0, 0.0, 0, "low", 0, "new")],
        "customer_id string, bureau_pull_date date, credit_score int, total_balance_inr bigint, "
        "total_credit_limit_inr bigint, credit_utilisation_pct double, delinquent_accounts int, "
        "hard_inquiries_6m int, delinquency_rate double, high_inquiry_flag int, "
        "utilisation_band string, available_credit_inr int, credit_age_band string",
    )
    return loans, credit


def test_debt_ratio_is_decimal_exact(spark):
    """0.1 + 0.2 style errors must not tip a rounded ratio."""
    from decimal import ROUND_HALF_UP, Decimal

    # includes 2198.54 / 80 = 27.48175, whose double quotient lies below the tie
    cases = [(219854, 0, 960)] + [(i * 37 + 11, i * 53 + 7, 960) for i in range(1, 400)]
    loans, credit = _loan_and_credit(spark, *cases[0])
    rows = spark.createDataFrame(cases, "loan_amount_inr bigint, bal bigint, inc bigint")
    number = F.row_number().over(Window.orderBy("loan_amount_inr"))
    rows = rows.withColumn("k", number.cast("string"))
    many_loans = loans.drop("loan_amount_inr", "annual_income_inr", "customer_id").join(
        rows.select("loan_amount_inr", F.col("inc").alias("annual_income_inr"), F.col("k").alias("customer_id"))
    )
    many_credit = credit.drop("customer_id", "total_balance_inr").join(
        rows.select(F.col("k").alias("customer_id"), F.col("bal").alias("total_balance_inr"))
    )
    cent = Decimal("0.01")
    for r in features.feat_dti_ratio(many_loans, many_credit).collect():
        emi = (Decimal(r.loan_amount_inr) / 100).quantize(cent, ROUND_HALF_UP)
        burden = (Decimal(r.bureau_total_balance_inr) / 60).quantize(cent, ROUND_HALF_UP)
        want = ((emi + burden) / Decimal(80)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        assert Decimal(str(r.dti_ratio)) == want
        assert Decimal(str(r.total_monthly_debt_inr)) == emi + burden


def test_utilisation_gap_is_decimal_exact(spark):
    _, credit = _loan_and_credit(spark, 1, 1, 1, util=0.3, limit=100)
    agg = spark.createDataFrame(
        [("C", 45.0, 0.0, 0.0, 0, 0, 0.5, 0.0, 0.0, 0, 10, 1)],
        "customer_id string, avg_monthly_spend_inr double, spend_volatility_inr double, "
        "peak_monthly_spend_inr double, emi_payment_count_12m bigint, "
        "total_emi_paid_inr_12m bigint, emi_regularity_score double, "
        "avg_balance_recent_3m double, avg_balance_earlier_9m double, "
        "total_flagged_txns bigint, total_txns_12m bigint, active_months_count bigint",
    )
    row = features.feat_credit_util(credit, agg).first()
    # 0.45 is not more than 0.30 + 0.15
    assert (row.txn_utilisation_estimate, row.utilisation_change_flag) == (0.45, 0)
    more = agg.withColumn("avg_monthly_spend_inr", F.lit(45.01))
    assert features.feat_credit_util(credit, more).first().utilisation_change_flag == 1
    assert row.credit_stress_score == 0


# --------------------------------------------------------------------------- decisions

CASES = [
    ("D", 0.4, 0.1, "low", 800, "DECLINE", "medium", 1),
    ("E", 0.9, None, None, None, "DECLINE", "medium", 1),
    ("A", 0.01, 0.7, "high", 800, "DECLINE", "medium", 1),
    ("A", 0.01, 0.1, "low", 549, "DECLINE", "medium", 1),
    ("A", 0.01, 0.1, "low", 550, "APPROVE", "high", 3),
    ("b", 0.1, 0.4, "Moderate", None, "APPROVE", "high", 2),
    ("C", 0.2, 0.4, "moderate", 700, "REFER", "medium", 1),
    ("A", 0.01, 0.45, "elevated", 700, "REFER", "medium", 1),
    ("A", 0.01, None, None, 700, "REFER", "medium", 1),
    (None, 0.01, 0.1, "low", 700, "REFER", "medium", 1),
]


@pytest.mark.parametrize("case", CASES)
def test_decisions(spark, case):
    *inputs, decision, confidence, reasons = case
    cols = (
        "risk_grade string, pd_probability_ens double, dti_ratio double, dti_risk_tier string, "
        "credit_score int"
    )
    row = decisions.decide(spark.createDataFrame([tuple(inputs)], cols)).first()
    assert (row.decision, row.confidence, len(row.reasoning)) == (decision, confidence, reasons)
    assert len(row.policy_refs) == (2 if decision == "APPROVE" else 1)


def test_reason_text(spark):
    cols = (
        "risk_grade string, pd_probability_ens double, dti_ratio double, dti_risk_tier string, "
        "credit_score int"
    )
    row = decisions.decide(spark.createDataFrame([("A", 0.0385, 0.345, "low", 712)], cols)).first()
    assert row.reasoning == [
        f"Risk grade A (PD {0.0385:.1%}) falls within standard approval threshold.",
        f"DTI ratio {0.345:.2f} classified as low risk, within approval bounds.",
        "Credit score 712 meets minimum product requirements.",
    ]


# --------------------------------------------------------------------------- registry


def _model(spark, version, auc, day):
    row = (version, auc, auc, auc, auc, 22, 80, 20, None, None, dt.datetime(2024, 1, day), None)
    return spark.createDataFrame([row], registry.REGISTRY_SCHEMA)


def _states(table):
    return {r.model_version: r.status for r in table.collect()}


def test_registry_transitions(spark):
    table = spark.createDataFrame([], registry.REGISTRY_SCHEMA)
    table = registry.register(table, _model(spark, "v1", 0.8, 1))
    assert _states(table) == {"v1": "active"}
    table = registry.register(table, _model(spark, "v2", 0.9, 2))
    assert _states(table) == {"v1": "active", "v2": "candidate"}
    table = registry.register(table, _model(spark, "v3", 0.8, 3), promote=True)
    assert _states(table)["v3"] == "candidate"
    table = registry.register(table, _model(spark, "v4", 0.85, 4), promote=True)
    assert _states(table) == {"v1": "retired", "v2": "candidate", "v3": "candidate", "v4": "active"}
    assert [r.model_version for r in registry.list_models(table).collect()] == [
        "v4", "v3", "v2", "v1",
    ]
    promoted = registry.promote(table, "v2")
    assert registry.active_model(promoted).first().model_version == "v2"
    assert _states(promoted)["v4"] == "retired"
    assert _states(registry.promote(promoted, "v2")) == _states(promoted)
    with pytest.raises(LookupError):
        registry.promote(table, "v9")


def test_registering_a_version_again_replaces_three_fields(spark):
    table = registry.register(
        spark.createDataFrame([], registry.REGISTRY_SCHEMA), _model(spark, "v1", 0.8, 1)
    )
    table = registry.register(table, _model(spark, "v1", 0.95, 9), promote=True)
    row = table.first()
    assert table.count() == 1
    assert (row.ensemble_auc, row.rf_auc, row.status) == (0.95, 0.8, "active")


def test_gate():
    registry.gate(0.70)
    with pytest.raises(registry.ModelRejected):
        registry.gate(0.6999)


# --------------------------------------------------------------------------- audit, landing


def test_latest_audit(spark):
    t = dt.datetime(2024, 1, 1)
    day = dt.date(2024, 1, 1)
    events = [
        audit.audit_event(spark, "r1", "loans", day, "running", t),
        audit.audit_event(spark, "r1", "loans", day, "success", t, row_count=5),
        audit.audit_event(spark, "r1", "bureau", day, "running", t),
        audit.audit_event(
            spark, "r1", "bureau", day, "failed", t + dt.timedelta(seconds=1), error_message="x"
        ),
    ]
    log = events[0]
    for e in events[1:]:
        log = log.unionByName(e)
    got = {r.source_name: (r.status, r.row_count) for r in audit.latest_audit(log).collect()}
    assert got == {"loans": ("success", 5), "bureau": ("failed", None)}


def test_schema_history(spark):
    day1 = spark.createDataFrame([("1", "a", "1.5"), ("2", "b", "2")], "n string, t string, f string")
    day2 = spark.createDataFrame([("1", "a"), (None, "b")], "n string, t string").withColumn(
        "extra", F.lit("7")
    )
    snaps = audit.schema_snapshot(day1, "s", F.lit("2024-01-01")).unionByName(
        audit.schema_snapshot(day2, "s", F.lit("2024-01-02"))
    )
    types = [r.column_dtypes for r in snaps.orderBy("snapshot_date").collect()]
    assert types == [
        {"n": "int64", "t": "object", "f": "float64"},
        {"n": "float64", "t": "object", "extra": "int64"},
    ]
    first, second = audit.schema_drift(snaps).orderBy("snapshot_date").collect()
    assert (first.changed, first.added, first.removed) == (False, [], [])
    assert (second.changed, second.added, second.removed, second.retyped) == (
        True, ["extra"], ["f"], ["n"],
    )


def _csv(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_csv_scan(spark, tmp_path):
    good = _csv(tmp_path, "macro.csv", "date,nifty_50_index,new_column\n2024-01-01,18000,x\n")
    df = landing.read_source(spark, "macro_indicators", good)
    assert dict(df.dtypes) == {"date": "date", "nifty_50_index": "bigint", "new_column": "string"}
    bad = _csv(tmp_path, "bad.csv", "date,nifty_50_index\n2024-01-01,many\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        landing.read_source(spark, "macro_indicators", bad).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landing.read_source(spark, "macro_indicators", str(tmp_path / "none.csv"))


def test_bronze_days(spark, tmp_path):
    base = str(tmp_path / "bronze")
    day1, day2 = dt.date(2024, 3, 1), dt.date(2024, 3, 2)
    landing.write_bronze(spark.range(5), base, "s", day1)
    landing.write_bronze(spark.range(7), base, "s", day2)
    landing.write_bronze(spark.range(6), base, "s", day2)  # a repeated run replaces its own day
    assert (tmp_path / "bronze" / "s" / "year=2024" / "month=03" / "day=02").is_dir()
    assert landing.read_bronze(spark, base, "s").count() == 11
    one = landing.read_bronze(spark, base, "s", day1)
    assert one.count() == 5
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "year=2024/month=03/day=01" in " ".join(one.inputFiles()) and "day=02" not in plan
    size = audit.file_bytes(spark.read.parquet(f"{base}/s")).first()[0]
    files = list((tmp_path / "bronze").rglob("*.parquet"))
    assert size == sum(f.stat().st_size for f in files)


def test_window_filter_reaches_the_landed_table(spark, tmp_path, conf):
    conf(maxMetadataStringLength="2000")
    columns = landing.SOURCE_COLUMNS["transactions"]
    day = dt.date(2024, 3, 1)
    rows = spark.createDataFrame(
        [("T1", "C1", dt.date(2024, 2, 1), 5, "debit", None, None, 7, 0),
         ("T2", "C1", dt.date(2020, 2, 1), 5, "debit", None, None, 7, 0)],
        columns,
    )
    landing.write_bronze(rows, str(tmp_path), "transactions", day)
    landed = landing.read_bronze(spark, str(tmp_path), "transactions")
    recent = features.recent_transactions(landed, day)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(transaction_date,2023-03-01)" in plan
    assert recent.count() == 1


def test_fingerprint(spark):
    import hashlib

    df = spark.range(3).select(F.col("id").alias("b"), F.lit("x").alias("a"))
    row = audit.profile_ingest(df, "s").first()
    assert row.row_hash == hashlib.sha256(b"['a', 'b']|3").hexdigest()[:16]
    assert (row.row_count, row.column_dtypes) == (3, {"b": "bigint", "a": "string"})


def test_batch_file_in_and_out(spark, sf, tmp_path):
    path = _csv(tmp_path, "ids.csv", "note, Application_ID \nx, app000000000005 \ny,nope\nz,\nx,app000000000005\n")
    decided = spark.createDataFrame(
        [("APP000000000005", "C1", 0.1, 0.2, 0.13, "B", "APPROVE", "high", ["r1", "r2"])],
        "application_id string, customer_id string, pd_probability_rf double, "
        "pd_probability_lr double, pd_probability_ens double, risk_grade string, "
        "decision string, confidence string, reasoning array<string>",
    )
    ids = landing.read_ids(spark, path)
    out = decisions.score_ids(ids, decided)
    assert out.columns == decisions.BATCH_COLUMNS
    target = str(tmp_path / "out")
    landing.write_csv(out, target)
    back = spark.read.option("header", True).csv(target).collect()
    assert sorted((r.application_id, r.decision, r.error) for r in back) == sorted(
        [("APP000000000005", "APPROVE", None)] * 2 + [("NOPE", None, "NOPE not found")],
        key=str,
    )
    assert landing.read_ids(spark, path, limit=1).count() == 1
    marked = _csv(tmp_path, "marked.csv", "\ufeffapplication_id\nA1\n")
    assert landing.read_ids(spark, marked).first()[0] == "A1"
    with pytest.raises(ValueError, match="application_id"):
        landing.read_ids(spark, _csv(tmp_path, "no.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError, match="no rows"):
        landing.read_ids(spark, _csv(tmp_path, "empty.csv", "application_id\n"))


def test_replace_table(spark):
    landing.replace_table(spark.range(3), "loom_replaced")
    landing.replace_table(spark.range(5).withColumn("x", F.lit(1)), "loom_replaced")
    assert spark.table("loom_replaced").count() == 5
    spark.sql("drop table loom_replaced")
