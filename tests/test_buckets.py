import pytest
from pyspark.sql import functions as F

from creditloom.operators.latest import upsert
from creditloom.sources import buckets

SCHEMA = "k bigint, model string, v string, n int"


def frame(spark, ids, tag):
    return spark.createDataFrame([(i, f"m{i % 2}", f"{tag}{i}", i) for i in ids], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_few_rows_rewrite_few_buckets(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k", "model"]
    assert buckets.read_keyed(spark, path) is None
    first = frame(spark, range(2000), "a")
    assert len(buckets.merge_keyed(first, path, keys)) == buckets.BUCKETS
    files = {f for f in buckets.read_keyed(spark, path).inputFiles()}
    update = frame(spark, [3, 700, *range(5000, 5008)], "b")
    touched = buckets.merge_keyed(update, path, keys)
    assert len(touched) <= 10
    want = upsert(first, update, keys)
    assert rows(buckets.read_keyed(spark, path)) == rows(want)
    stay = files & set(buckets.read_keyed(spark, path).inputFiles())
    assert len({f.split("_bucket=")[1].split("/")[0] for f in stay}) == buckets.BUCKETS - len(touched)
    # some columns alone, and rows that are there stay as they are
    later = frame(spark, [3, 9000], "c")
    buckets.merge_keyed(later.withColumn("n", F.lit(-1)), path, keys, update_columns=["v"])
    want = upsert(want, later.withColumn("n", F.lit(-1)), keys, ["v"])
    buckets.merge_keyed(frame(spark, [3, 9001], "d"), path, keys, on_conflict="ignore")
    want = upsert(want, frame(spark, [3, 9001], "d"), keys, on_conflict="ignore")
    assert rows(buckets.read_keyed(spark, path)) == rows(want)
    for n in range(4):
        buckets.merge_keyed(frame(spark, [3], f"e{n}"), path, keys)
    assert len(list((tmp_path / "t").glob(f"merge-*/_bucket={touched[0]}"))) <= 3


def test_merges_of_two_writers(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "t"), ["k"]
    buckets.merge_keyed(frame(spark, range(20), "a"), path, keys, buckets=4)
    met, plain = [], buckets.upsert

    def slow(old, new, *args):
        if not met:
            met.append(1)
            buckets.merge_keyed(frame(spark, [100, 101, 102], "b"), path, keys, buckets=4)
        return plain(old, new, *args)

    monkeypatch.setattr(buckets, "upsert", slow)
    buckets.merge_keyed(frame(spark, [200, 201, 202], "c"), path, keys, buckets=4)
    got = {r.k for r in buckets.read_keyed(spark, path).collect()}
    assert got == {*range(20), 100, 101, 102, 200, 201, 202}


def test_odd_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    assert buckets.merge_keyed(frame(spark, [], "a"), path, ["k"]) == []
    buckets.merge_keyed(frame(spark, [1], "a"), path, ["k"], buckets=4)
    with pytest.raises(ValueError, match="buckets"):
        buckets.merge_keyed(frame(spark, [1], "a"), path, ["k"], buckets=5)
    with pytest.raises(Exception, match="repeated key"):
        buckets.merge_keyed(frame(spark, [1, 1], "a"), path, ["k"], buckets=4)
    assert buckets.read_keyed(spark, path).count() == 1
