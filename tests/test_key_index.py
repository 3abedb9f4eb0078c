"""Loads into a table with a key index: same rows as the join with the whole target, and which files they read."""

import random

import pytest
from pyspark.sql import functions as F

from tableward.operators import changes as H
from tableward.sources import key_index as K

KIND = "k long, t string, v long"


def frame(spark, keys, v=0):
    return spark.createDataFrame([(k, None if k is None else str(k), v) for k in keys], KIND)


def test_reads_only_files_that_may_hold_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    first = K.append_indexed(frame(spark, range(0, 4000, 2)), path, ["k"], files=8)
    assert first == {"load": 1, "added": 2000, "files_read": 0, "files": 0}
    # beyond every range: nothing to read
    assert K.append_indexed(frame(spark, range(5000, 5100)), path, ["k"], files=1)["files_read"] == 0
    # inside the ranges of all files, but in none of them: the Bloom filters tell
    inside = K.append_indexed(frame(spark, range(101, 4000, 400)), path, ["k"], files=1)
    assert inside["added"] == 10 and inside["files"] == 9 and inside["files_read"] <= 2
    # keys of one file, repeated
    known = K.append_indexed(frame(spark, [10, 12, 12, 14], v=9), path, ["k"], files=1)
    assert known["added"] == 0 and 1 <= known["files_read"] <= 3 < known["files"]
    out = K.read_indexed(spark, path, frame(spark, []).schema, ["k"])
    assert out.count() == 2110 == out.select("k").distinct().count() and out.agg(F.max("v")).first()[0] == 0


@pytest.mark.parametrize("words", [1, 64, K.WORDS])
def test_same_rows_as_the_join(spark, tmp_path, words):
    """Random batches, keys of two columns with missing values; one word per file lets every key through and changes nothing."""
    rng, path = random.Random(words), str(tmp_path / "t")
    want = None
    for n in range(4):
        keys = [None if rng.random() < 0.05 else rng.randrange(300) for _ in range(120)]
        batch = frame(spark, keys, v=n)
        added = K.append_indexed(batch, path, ["k", "t"], files=3, words=words)["added"]
        before = 0 if want is None else want.count()
        want = H.idempotent_append(batch.limit(0) if want is None else want, batch, ["k", "t"])
        want = spark.createDataFrame(want.collect(), KIND)
        assert added == want.count() - before
    got = K.read_indexed(spark, path, want.schema, ["k", "t"])
    order = lambda rows: sorted(rows, key=str)
    assert order(got.collect()) == order(want.collect())


def test_failed_load_is_no_part_of_the_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), frame(spark, []).schema
    assert K.read_indexed(spark, path, schema, ["k"]).count() == 0
    K.append_indexed(frame(spark, [1, 2]), path, ["k"])
    frame(spark, [3, 4], v=7).write.parquet(f"{path}/load=2")  # as if lost before the index row
    assert K.read_indexed(spark, path, schema, ["k"]).count() == 2
    assert K.append_indexed(frame(spark, [2, 3]), path, ["k"]) == {"load": 2, "added": 1, "files_read": 1, "files": 1}
    assert sorted(r.k for r in K.read_indexed(spark, path, schema, ["k"]).collect()) == [1, 2, 3]


def test_empty_batches_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "t")
    none = frame(spark, [])
    assert K.append_indexed(none, path, ["k"])["added"] == 0
    assert K.append_indexed(frame(spark, [5, 5]), path, ["k"])["added"] == 1
    assert K.append_indexed(none, path, ["k"])["added"] == 0
    assert K.read_indexed(spark, path, none.schema, ["k"]).count() == 1
    named = spark.createDataFrame([(1, "a", 2)], "k long, path string, word int")
    other = str(tmp_path / "u")
    for added in (1, 0):
        assert K.append_indexed(named, other, ["k"])["added"] == added
    with pytest.raises(ValueError):
        K.append_indexed(named.withColumn("load", F.lit(1)), other, ["k"])
