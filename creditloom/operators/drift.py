"""Distribution drift of the scores: two-sample Kolmogorov-Smirnov and a daily snapshot."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import bands
from creditloom.operators.ordering import with_running_sums
from creditloom.operators.portfolio import grade_share_columns

KOLMOGOROV_TERMS = 100


@dataclass(frozen=True)
class Period:
    """A half-open time range on a timestamp column."""

    column: str
    column_type: str
    start: str
    end: str

    def holds(self) -> Column:
        """Range condition on the raw column, so that it is pushed down to the Parquet scan."""
        start, end = (F.lit(t).cast(self.column_type) for t in (self.start, self.end))
        return (F.col(self.column) >= start) & (F.col(self.column) < end)


def scoring_periods(
    predictions: DataFrame, grain: str = "day", at: str = "scored_at"
) -> tuple[Period, Period] | None:
    """The first and the last scoring day (or month, or year); one row is read."""
    starts = predictions.agg(
        F.date_trunc(grain, F.min(at)).alias("first"), F.date_trunc(grain, F.max(at)).alias("last")
    )
    ends = [F.expr(f"cast(timestampadd({grain.upper()}, 1, {c}) as string)") for c in starts.columns]
    row = starts.select(*[F.col(c).cast("string") for c in starts.columns], *ends).first()
    if row[0] is None:
        return None
    kind = predictions.schema[at].dataType.simpleString()
    return Period(at, kind, row[0], row[2]), Period(at, kind, row[1], row[3])


def on_extreme_day(predictions: DataFrame, which: str, grain: str = "day") -> DataFrame:
    """Rows of the first ('min') or last ('max') scoring day."""
    periods = scoring_periods(predictions, grain)
    if periods is None:
        return predictions.where(F.lit(False))
    return predictions.where(periods[{"min": 0, "max": 1}[which]].holds())


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2), 1 at D = 0."""
    lam2 = statistic * statistic * (n * m / (n + m))

    def term(acc: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        return acc + sign * F.exp(F.lit(-2.0) * k * k * lam2)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)), F.lit(0.0), term)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2))
    return F.when(statistic <= 0, F.lit(1.0)).otherwise(clipped)


def exact_p(statistic: float, n: int, m: int) -> float:
    """Exact two-sided p-value: share of the orders of n + m values whose gap is as large.

    An order is a walk from (0, 0) to (n, m).  The chance of being at (i, j) without having
    reached the gap is carried on one step at a time, over all i at once.  Needs three numbers
    only; the walk has n + m steps of at most n + 1 cells.
    """
    limit = round(statistic * n * m)
    if limit <= 0:
        return 1.0
    i = np.arange(n + 1)
    alive = np.zeros(n + 1)
    alive[0] = 1.0
    for step in range(1, n + m + 1):
        left = n + m - step + 1
        came_from_b = alive * (m - (step - 1 - i)) / left
        came_from_a = np.zeros(n + 1)
        came_from_a[1:] = alive[:-1] * (n - i[:-1]) / left
        j = step - i
        gap = np.abs(i * m - j * n)
        alive = np.where((j >= 0) & (j <= m) & (gap < limit), came_from_a + came_from_b, 0.0)
    return float(min(1.0, max(0.0, 1.0 - alive[n])))


def ks_two_sample(
    df: DataFrame, value: str, in_a: Column, in_b: Column, method: str = "asymptotic"
) -> DataFrame:
    """One row: sample sizes, largest gap between the two distribution functions, p-value.

    Values are counted per sample first; only distinct values take part in the ordering.
    ``method``: ``asymptotic``, or ``exact`` for small samples (its work grows with their
    product, on the driver).
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"method must be 'asymptotic' or 'exact', not {method!r}")
    counts = (
        df.where((in_a | in_b) & F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("value"))
        .agg(F.count_if(in_a).alias("a"), F.count_if(in_b).alias("b"))
    )
    running = with_running_sums(counts, [F.col("value")], {"cum_a": "a", "cum_b": "b"})
    sizes = running.agg(F.sum("a").alias("n"), F.sum("b").alias("m")).first()
    n, m = float(sizes["n"] or 0), float(sizes["m"] or 0)
    gap = F.abs(
        F.try_divide(F.col("cum_a").cast("double"), F.lit(n))
        - F.try_divide(F.col("cum_b").cast("double"), F.lit(m))
    )
    stat = running.agg(F.max(gap).alias("_d"))
    p = kolmogorov_p(F.col("_d"), F.lit(n), F.lit(m))
    if min(n, m) > 0 and method == "exact":
        p = F.lit(exact_p(stat.first()["_d"], int(n), int(m)))
    return stat.select(
        F.lit(int(n)).cast("bigint").alias("n_baseline"),
        F.lit(int(m)).cast("bigint").alias("n_current"),
        F.round("_d", 6).alias("ks_statistic"),
        F.round(p, 6).alias("ks_pvalue"),
    )


def drift_snapshot(
    predictions: DataFrame,
    snapshot_date: dt.date,
    grain: str = "day",
    model_version: str | None = None,
    method: str = "asymptotic",
) -> DataFrame:
    """Monitoring row: the last scoring day compared with the first one.

    All model versions are pooled unless one is named; the row is labelled with the greatest
    version scored on the last day.
    """
    if model_version is not None:
        predictions = predictions.where(F.col("model_version") == model_version)
    periods = scoring_periods(predictions, grain)
    if periods is None:
        raise ValueError("no predictions to compare")
    first, last = periods
    ks = ks_two_sample(
        predictions, "pd_probability_ens", first.holds(), last.holds(), method
    ).first()
    row = predictions.where(last.holds()).agg(
        F.max("model_version").alias("model_version"),
        F.lit(snapshot_date).alias("snapshot_date"),
        F.count(F.lit(1)).alias("total_scored"),
        F.round(F.avg("pd_probability_ens"), 6).alias("avg_pd"),
        F.round(F.stddev_pop("pd_probability_ens"), 6).alias("std_pd"),
        *grade_share_columns(),
        F.lit(ks["ks_statistic"]).alias("ks_statistic"),
        F.lit(ks["ks_pvalue"]).alias("ks_pvalue"),
    )
    severity = bands.drift_severity(F.col("ks_statistic"), F.col("ks_pvalue"))
    return row.withColumns(
        {"drift_detected": severity != bands.DRIFT_STEPS[0][1], "drift_severity": severity}
    )


#: Fields that a repeated snapshot of the same version and day replaces.
SNAPSHOT_UPDATES = ["ks_statistic", "ks_pvalue", "drift_detected", "drift_severity"]
