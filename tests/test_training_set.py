import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from creditloom.operators import training_set as ts


def _numbers(spark, n=4000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        rows.append(
            (
                rng.gauss(0, 1),
                # one value holds a third of the column
                0.0 if rng.random() < 0.34 else rng.random(),
                None if rng.random() < 0.2 else float(rng.randint(-5, 5)),
                None,
                float(i),
            )
        )
    return rows, spark.createDataFrame(rows, "a double, b double, c double, d double, e double")


def test_exact_medians(spark):
    rows, df = _numbers(spark)
    got = {
        r.feature: r.median_value
        for r in ts.exact_medians(df, list("abcde")).collect()
    }
    for i, c in enumerate("abcde"):
        values = [r[i] for r in rows if r[i] is not None]
        want = statistics.median(values) if values else None
        assert got[c] == want, c


def test_medians_when_the_bracket_misses(spark, monkeypatch):
    """A bracket around the wrong place is noticed and opened to the whole column."""
    rows, df = _numbers(spark, 501)
    monkeypatch.setattr(ts, "_BRACKET", -0.2)
    got = ts.exact_medians(df, ["a"]).first().median_value
    assert got == statistics.median(r[0] for r in rows)


@pytest.mark.parametrize("cells", [20, 10_000])
def test_medians_of_folds(spark, monkeypatch, cells):
    """All folds at once; brackets of many different values are narrowed."""
    monkeypatch.setattr(ts, "_CELLS", cells)
    rng = random.Random(1)
    rows = [(i % 3, rng.choice([None, rng.random(), 2.0]), rng.randint(0, 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "fold int, x double, y int")
    got = ts.fold_medians(df, ["x", "y"], 3)
    for i in range(3):
        for n, c in ((1, "x"), (2, "y")):
            assert got[i][c] == statistics.median(r[n] for r in rows if r[0] != i and r[n] is not None)


def _dealt(rng, by_value):
    rows = []
    for n in range(2000):
        x = rng.choice([None, rng.gauss(0, 9), 1.5])
        fold = rng.choice([None, 0, 1, 2, 3]) if not by_value else int(abs(x or 0) // 5)
        rows.append((fold, x, rng.randint(0, 50), None, 7.0 if fold == 1 else None))
    return rows


@pytest.mark.parametrize("cells", [3, 10_000])
@pytest.mark.parametrize("by_value", [False, True])
def test_folds_share_brackets(spark, monkeypatch, by_value, cells):
    """Three of the folds are asked for; rows of others count, rows without a fold do not."""
    rows = _dealt(random.Random(3), by_value)
    df = spark.createDataFrame(rows, "fold int, x double, y int, z double, one double")
    if not by_value and cells > 3:  # one bracket a column is enough
        monkeypatch.setattr(ts, "medians_of", None)
    monkeypatch.setattr(ts, "_CELLS", cells)
    got = ts.fold_medians(df, ["x", "y", "z", "one"], 3)
    for i in range(3):
        for n, c in enumerate(["x", "y", "z", "one"], 1):
            values = [r[n] for r in rows if r[0] not in (None, i) and r[n] is not None]
            assert got[i][c] == (statistics.median(values) if values else None), (i, c)


def test_time_split_cuts_inside_a_hot_day(spark):
    hot = dt.date(2020, 1, 2)
    rows = [(f"A{i:04d}", dt.date(2020, 1, 1)) for i in range(10)]
    rows += [(f"B{i:04d}", hot) for i in range(80)]
    rows += [(f"C{i:04d}", dt.date(2020, 1, 3)) for i in range(9)] + [("D0000", None)]
    df = spark.createDataFrame(rows, "application_id string, application_date date")
    split = {r.application_id: r.split for r in ts.time_split(df.repartition(6)).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or hot, r[0]))
    want = {r[0]: "train" if i < 80 else "test" for i, r in enumerate(ordered)}
    assert split == want


@pytest.mark.parametrize("n", [1, 5, 10])
def test_time_split_sizes(spark, n):
    rows = [(f"A{i}", dt.date(2020, 1, 1 + i)) for i in range(n)]
    df = spark.createDataFrame(rows, "application_id string, application_date date")
    train = ts.time_split(df).where("split = 'train'").count()
    assert train == int(n * 0.8)


def test_folds_are_even_per_class(spark):
    rows = [(f"A{i:05d}", int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "application_id string, default_flag int")
    folds = ts.cv_folds(df).groupBy("default_flag", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.default_flag == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "default_flag int")
    got = {r.default_flag: r.class_weight for r in ts.class_weights(df).collect()}
    assert got == {0: 40 / (2 * 30), 1: 40 / (2 * 10)}
    weighted = df.withColumn("w", ts.class_weight(ts.class_counts(df)))
    sums = weighted.groupBy("default_flag").agg(F.sum("w")).collect()
    assert [pytest.approx(20.0)] * 2 == [r[1] for r in sums]


def test_encoding(spark):
    train = spark.createDataFrame(
        [(1.0, "x"), (3.0, None), (None, "y"), (8.0, "x")], "n double, c string"
    )
    spec = ts.fit_features(train, ["n"], ["c"])
    assert spec.columns == ["n", "c_unknown", "c_x", "c_y"]
    new = spark.createDataFrame([(None, "z"), (2.0, "y")], "n double, c string")
    assert [tuple(r) for r in ts.encode(new, spec).collect()] == [
        (3.0, 0.0, 0.0, 0.0),
        (2.0, 0.0, 0.0, 1.0),
    ]
    aligned = ts.align(new, ["missing", "n"]).collect()
    assert [tuple(r) for r in aligned] == [(0.0, 0.0), (0.0, 2.0)]


def test_too_many_levels_is_an_error(spark):
    df = spark.range(ts.MAX_LEVELS + 1).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than"):
        ts.category_levels(df, ["c"])
