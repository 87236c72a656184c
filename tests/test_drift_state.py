import datetime as dt
import random
from itertools import combinations

import pytest

from creditloom.operators import drift_state as ds

DAYS = [dt.date(2024, 1, d) for d in range(1, 6)]


def exact_gap(a, b):
    points = sorted({*a, *b})
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("points", [7, 50, 1000])
def test_gaps_of_all_pairs_are_within_the_bound(spark, tmp_path, points):
    rng = random.Random(points)
    draw = [
        lambda: rng.random(),
        lambda: rng.random() ** 3,
        lambda: rng.choice([0.2, 0.2, 0.7, rng.random()]),  # scores that many rows share
        lambda: 0.5,
        lambda: round(rng.random(), 1),
    ]
    scores = {day: [draw[n]() for _ in range(rng.randint(3, 400))] for n, day in enumerate(DAYS)}
    path = str(tmp_path / "states")
    for day, values in scores.items():
        rows = [(x, dt.datetime.combine(day, dt.time(n % 24))) for n, x in enumerate(values)]
        rows += [(None, dt.datetime.combine(day, dt.time())), (0.1, None)]
        df = spark.createDataFrame(rows, "pd_probability_ens double, scored_at timestamp")
        ds.keep_states(df, path, day, points=points)
    states = ds.kept_states(spark, path)
    assert states.groupBy("period").count().groupBy().max("count").first()[0] <= points + 1
    pairs = spark.createDataFrame([*combinations(DAYS, 2)], "a date, b date")
    found = {(r.a, r.b): r.gap for r in ds.gaps(states, pairs).collect()}
    assert len(found) == 10
    for (a, b), gap in found.items():
        assert abs(gap - exact_gap(scores[a], scores[b])) <= 1 / points + 1e-12
        if len(set(scores[a])) + len(set(scores[b])) < points and points == 1000:
            assert gap == pytest.approx(exact_gap(scores[a], scores[b]))
    assert [(r.a, r.b) for r in ds.neighbours(states).orderBy("b").collect()] == [*zip(DAYS, DAYS[1:])]


def test_no_states(spark, tmp_path):
    with pytest.raises(LookupError):
        ds.kept_states(spark, str(tmp_path))
    none = spark.createDataFrame([], "pd_probability_ens double, scored_at timestamp")
    assert ds.score_states(none).count() == 0
