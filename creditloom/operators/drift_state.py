"""Drift between days from small states, without reading old predictions again.

The state of a day has the scores at which the running count passes a multiple of total / POINTS,
each with its exact running count.  Strictly between two of them lies less than 1 / POINTS of the
day, so the share of scores up to any point is known within that bound, a score that many rows
share included.  The greatest gap between two days (the two-sample KS statistic) is therefore
within 1 / POINTS of the exact one.  States merge: shares of several days, weighted by their rows,
keep the bound.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditloom.operators.ordering import with_running_sums
from creditloom.sources.snapshots import read_parts, replace_part

POINTS = 1000


def score_states(
    predictions: DataFrame,
    score: str = "pd_probability_ens",
    at: str = "scored_at",
    grain: str = "day",
    points: int = POINTS,
) -> DataFrame:
    """``period``, ``value``, ``upto`` (rows of the period up to it), ``n`` (rows with it) and
    ``total``: at most ``points`` + 1 rows a period.  Rows are counted by score before they move."""
    period = F.date_trunc(grain, F.col(at)).cast("date").alias("period")
    counts = (
        predictions.where(F.col(score).isNotNull() & F.col(at).isNotNull())
        .groupBy(period, F.col(score).cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    running = with_running_sums(counts, [F.col("period"), F.col("value")], {"running": "n"})
    # one row per period
    totals = running.groupBy("period").agg(
        F.sum("n").alias("total"), (F.max("running") - F.sum("n")).alias("start")
    )
    upto = F.col("running") - F.col("start")
    placed = running.join(F.broadcast(totals), "period").withColumn("upto", upto)
    passed = F.floor(F.col("upto") * points / F.col("total")) > F.floor(
        (F.col("upto") - F.col("n")) * points / F.col("total")
    )
    return placed.where(passed).select("period", "value", "upto", "n", "total")


def keep_states(predictions: DataFrame, path: str, day: dt.date, **kw) -> None:
    """Keep the state of the scores of one day; a repeated run replaces it."""
    replace_part(score_states(predictions, **kw), path, day.isoformat())


def kept_states(spark: SparkSession, path: str) -> DataFrame:
    states = read_parts(spark, path)
    if states is None:
        raise LookupError(f"no drift states in {path}")
    return states


def gaps(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``gap``): the greatest difference of shares of each pair of periods.

    ``pairs`` has ``a`` and ``b``; a pair has at most twice POINTS + 2 points, so its points
    are ordered in one window.
    """
    point = ["value", "upto", "total"]
    of_a = pairs.join(states.select(F.col("period").alias("a"), *point), "a").withColumn("side", F.lit(0))
    of_b = pairs.join(states.select(F.col("period").alias("b"), *point), "b").withColumn("side", F.lit(1))
    so_far = W.partitionBy("a", "b").orderBy("value")  # equal values count together

    def share(side: int):
        own = F.when(F.col("side") == side, F.col("upto") / F.col("total"))
        return F.coalesce(F.max(own).over(so_far), F.lit(0.0))

    both = of_a.unionByName(of_b).withColumn("gap", F.abs(share(0) - share(1)))
    return both.groupBy("a", "b").agg(F.max("gap").alias("gap"))


def neighbours(states: DataFrame) -> DataFrame:
    """Each period with the one before it; one small row per period."""
    periods = states.select("period").distinct()
    return periods.select(
        F.lag("period").over(W.orderBy("period")).alias("a"), F.col("period").alias("b")
    ).where(F.col("a").isNotNull())
