import math
import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import drift, metrics, portfolio


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.4)
        rows.append((round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.25))), 2), y, f"m{i % 2}"))
    return rows, spark.createDataFrame(rows, "s double, y int, g string").cache()


def _auc(rows):
    pos = [s for s, y, *_ in rows if y]
    neg = [s for s, y, *_ in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_equals_pair_counting(scored):
    rows, df = scored
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(_auc(rows), abs=1e-8)
    mirrored = metrics.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert mirrored == pytest.approx(1 - _auc(rows), abs=1e-8)


def test_auc_by_group(scored):
    rows, df = scored
    got = {r.g: r.auc for r in metrics.roc_auc(df, "s", "y", by=["g"]).collect()}
    for g in ("m0", "m1"):
        assert got[g] == pytest.approx(_auc([r for r in rows if r[2] == g]), abs=1e-8)


def test_average_precision(scored):
    rows, df = scored
    total, ap = sum(y for _, y, _ in rows), 0.0
    for t in sorted({s for s, *_ in rows}, reverse=True):
        above = [y for s, y, _ in rows if s >= t]
        ap += sum(y for s, y, _ in rows if s == t) / total * sum(above) / len(above)
    got = metrics.average_precision(df, "s", "y").first()["average_precision"]
    assert got == pytest.approx(ap, abs=1e-8)


def test_curves_start_and_end_where_they_must(scored):
    _, df = scored
    roc = sorted((r.fpr, r.tpr) for r in metrics.roc_points(df, "s", "y").collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    pr = metrics.pr_points(df, "s", "y").collect()
    assert (None, 1.0, 0.0) in [tuple(r) for r in pr]
    assert max(r.recall for r in pr) == 1.0


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first()["auc"] is None


def _ks(a, b):
    points = sorted(set(a) | set(b))
    return max(
        abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points
    )


def test_ks(scored):
    rows, df = scored
    a, b = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    row = drift.ks_two_sample(df, "s", F.col("y") == 1, F.col("y") == 0).first()
    d = _ks(a, b)
    assert row.ks_statistic == pytest.approx(d, abs=1e-6)
    lam2 = d * d * len(a) * len(b) / (len(a) + len(b))
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam2) for k in range(1, 101))
    assert row.ks_pvalue == pytest.approx(p, abs=1e-6)


def test_ks_of_a_sample_with_itself(scored):
    _, df = scored
    row = drift.ks_two_sample(df, "s", F.lit(True), F.lit(True)).first()
    assert (row.ks_statistic, row.ks_pvalue) == (0.0, 1.0)


def test_running_counts_use_no_single_partition(scored):
    _, df = scored
    for out in (metrics.roc_points(df, "s", "y"), metrics._descending(df, "s", "y")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def _predictions(spark, rows):
    df = spark.createDataFrame(rows, "pd_probability_ens double, risk_grade string, day string")
    return df.select(
        "pd_probability_ens",
        "risk_grade",
        F.col("day").cast("timestamp_ntz").alias("scored_at"),
        F.lit("v1").alias("model_version"),
    )


def test_extreme_days_and_shares(spark):
    rows = [(0.1, "B", "2024-01-01 10:00:00"), (0.2, "C", "2024-01-01 23:59:59")]
    rows += [(0.6, "E", "2024-01-03 00:00:00"), (0.02, "A", "2024-01-02 12:00:00")]
    df = _predictions(spark, rows)
    first = drift.on_extreme_day(df, "min")
    assert sorted(r[0] for r in first.collect()) == [0.1, 0.2]
    assert [r[0] for r in drift.on_extreme_day(df, "max").collect()] == [0.6]
    shares = portfolio.grade_shares(df).first()
    assert tuple(shares) == (25.0, 25.0, 25.0, 0.0, 25.0)
    assert drift.on_extreme_day(df.where("false"), "min").count() == 0
    assert portfolio.portfolio_kpis(df.where("false")).first().asDict() == {
        "total_applications": 0,
        "portfolio_avg_pd": 0.0,
        "high_risk_count": 0,
        "high_risk_pct": 0.0,
    }


def test_extreme_day_filter_reaches_the_scan(spark, tmp_path):
    rows = [(0.1, "B", "2024-01-01 10:00:00"), (0.6, "E", "2024-01-03 00:00:00")]
    path = str(tmp_path / "p")
    _predictions(spark, rows).write.parquet(path)
    plan = drift.on_extreme_day(spark.read.parquet(path), "max")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(scored_at" in text


def test_drift_is_found(spark):
    rows = [(i / 200, "A", "2024-01-01") for i in range(100)]
    rows += [(0.5 + i / 200, "E", "2024-01-05") for i in range(100)]
    import datetime as dt

    snap = drift.drift_snapshot(_predictions(spark, rows), dt.date(2024, 1, 5)).first()
    assert snap.drift_detected and snap.drift_severity == "severe"
    assert snap.total_scored == 100 and snap.pct_grade_e == 100.0
