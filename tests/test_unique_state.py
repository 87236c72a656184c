import datetime as dt
import random
from collections import Counter

import pytest

from creditloom.operators import quality, unique_state as us

DAYS = [dt.date(2024, 1, d) for d in range(1, 5)]


@pytest.mark.parametrize("bits", [64, us.BITS])
def test_same_groups_as_the_full_check(spark, tmp_path, bits):
    """Keys repeat inside a landing, across landings, and a third of all rows share one key."""
    rng, path = random.Random(bits), str(tmp_path / "bits")
    days = [
        [rng.choice([None, "hot", "hot", *[f"k{rng.randint(0, 900)}" for _ in range(3)]]) for _ in range(150)]
        for _ in DAYS
    ]
    frames = [spark.createDataFrame([(k, n) for n, k in enumerate(d)], "key string, n int") for d in days]
    failing, earlier = None, None
    for n, (day, frame) in enumerate(zip(DAYS, frames)):
        bitmaps = us.kept_bitmaps(spark, path, DAYS[:n])
        found, looked_for = us.repeated_keys(frame, earlier, bitmaps, "key", bits)
        before = {k for d in days[:n] for k in d} - {None}
        really = {k for k in days[n] if k in before}
        looked = {r["key"] for r in looked_for.collect()}
        assert really <= looked <= set(days[n]) - {None}
        if bits > 1000:
            assert looked == really  # no two of so few keys share a bit
        failing = us.failing_after(failing, found, "key")
        us.keep_bitmaps(frame, path, day, "key", bits)
        earlier = frame if earlier is None else earlier.unionByName(frame)
        counts = Counter(k for d in days[: n + 1] for k in d if k is not None)
        assert dict(map(tuple, failing.collect())) == {k: c for k, c in counts.items() if c > 1}
    check = quality.Check("t", "key", "unique")
    assert sorted(failing.collect()) == sorted(quality.failing_values(earlier, check).collect())


def test_nothing_kept(spark, tmp_path):
    assert us.kept_bitmaps(spark, str(tmp_path)) is None
    none = spark.createDataFrame([], "key string")
    assert us.repeated_keys(none, None, None, "key")[0].count() == 0


def test_new_keys_alone_are_not_counted_again(spark, tmp_path, monkeypatch):
    """Of a landing's keys only those that may be repeated meet the earlier rows."""
    written = {}

    def noted(df, name):
        written[name] = (us_write(df, name), df.inputFiles())
        return written[name][0]

    us_write = us.write_stage
    monkeypatch.setattr(us, "write_stage", noted)
    old = spark.createDataFrame([("a",), ("b",)], "key string")
    new = spark.createDataFrame([("a",), ("c",), ("c",), *[(f"k{i}",) for i in range(500)]], "key string")
    us.keep_bitmaps(old, str(tmp_path), DAYS[0], "key")
    found, looked_for = us.repeated_keys(new, old, us.kept_bitmaps(spark, str(tmp_path)), "key")
    assert sorted(map(tuple, found.collect())) == [("a", 2), ("c", 2)]
    assert [r.key for r in looked_for.collect()] == ["a"]
    assert written["looked-for"][0].count() == 2
    assert not any("new-keys" in path for path in written["repeated"][1])
