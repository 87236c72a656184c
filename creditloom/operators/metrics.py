"""Exact classifier metrics from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ordering import with_running_sums


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before the shuffle."""
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) != 1).alias("neg"),
        )
    )


def _descending(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Score counts with true and false positives at each threshold ``score >= s``.

    With groups the sums run on from one group to the next; the value a group starts from is
    the smallest ``fp - neg`` (or ``tp - pos``) in it.
    """
    counts = score_counts(df, score, label, by)
    order = [*[F.col(c) for c in by], F.col("score").desc()]
    return with_running_sums(counts, order, {"tp": "pos", "fp": "neg"})


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, one row (per group); tied scores count half.

    A positive loses to every negative with a higher score and draws with equal ones.
    """
    ranked = _descending(df, score, label, by)
    above = F.col("fp").cast("double") - F.col("neg") / F.lit(2.0)
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * above).alias("_above"),
        F.min(F.col("fp") - F.col("neg")).alias("_start"),
    )
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    lost = F.col("_above") - F.col("_start") * p
    auc = F.when((p > 0) & (n > 0), F.round(1 - lost / (p * n), 8))
    return sums.select(*by, "positives", "negatives", auc.alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum of precision times recall step over descending thresholds."""
    ranked = _descending(df, score, label)
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    sums = ranked.agg(
        F.sum("pos").alias("positives"), F.sum(F.col("pos") * precision).alias("_gain")
    )
    ap = F.when(F.col("positives") > 0, F.round(F.col("_gain") / F.col("positives"), 8))
    return sums.select("positives", ap.alias("average_precision"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin (NULL threshold)."""
    ranked = _descending(df, score, label)
    totals = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = float(totals["p"] or 0), float(totals["n"] or 0)
    points = ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.lit(n)).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.lit(p)).alias("tpr"),
    )
    return points.unionByName(_anchor(df, "cast(null as double) threshold", "0D fpr", "0D tpr"))


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall) for every distinct score, plus the (1, 0) end point."""
    ranked = _descending(df, score, label)
    p = float(ranked.agg(F.sum("pos").alias("p")).first()["p"] or 0)
    points = ranked.select(
        F.col("score").alias("threshold"),
        (F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.lit(p)).alias("recall"),
    )
    return points.unionByName(
        _anchor(df, "cast(null as double) threshold", "1D precision", "0D recall")
    )


def _anchor(df: DataFrame, *columns: str) -> DataFrame:
    return df.sparkSession.range(1).selectExpr(*columns)


def classification_report(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages."""
    cells = (
        df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(label).alias("l"), F.col(prediction).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def total(condition=None):
        n = F.col("n") if condition is None else F.when(condition, F.col("n"))
        return F.coalesce(F.sum(n), F.lit(0)).cast("double")

    names = {0: "no_default", 1: "default"}
    sums = []
    for k in names:
        sums += [
            total((F.col("l") == k) & (F.col("p") == k)).alias(f"hit{k}"),
            total(F.col("p") == k).alias(f"said{k}"),
            total(F.col("l") == k).alias(f"was{k}"),
        ]
    one = cells.agg(*sums)

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    per_class = {}
    for k in names:
        hit, said, was = (F.col(f"{w}{k}") for w in ("hit", "said", "was"))
        per_class[k] = (safe(hit, said), safe(hit, was), safe(2 * hit, said + was), was)
    support = F.col("was0") + F.col("was1")
    accuracy = safe(F.col("hit0") + F.col("hit1"), support)
    rows = [(names[k], *per_class[k]) for k in names]
    rows.append(("accuracy", accuracy, accuracy, accuracy, support))
    macro = [(per_class[0][i] + per_class[1][i]) / 2 for i in range(3)]
    rows.append(("macro avg", *macro, support))
    weighted = [
        safe(per_class[0][i] * F.col("was0") + per_class[1][i] * F.col("was1"), support)
        for i in range(3)
    ]
    rows.append(("weighted avg", *weighted, support))
    structs = [
        F.struct(
            F.lit(name).alias("class"),
            F.round(p, 6).alias("precision"),
            F.round(r, 6).alias("recall"),
            F.round(f1, 6).alias("f1_score"),
            s.cast("bigint").alias("support"),
        )
        for name, p, r, f1, s in rows
    ]
    return one.select(F.inline(F.array(*structs)))
