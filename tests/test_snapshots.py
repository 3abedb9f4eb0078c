"""Stored snapshots: the tree finds the buckets that differ, and the comparison is that of whole snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from tableward.operators import changes as H
from tableward.sources import snapshots as S

KIND = "k long, a string, b double"


def test_one_changed_row_joins_one_bucket(spark, tmp_path):
    df = spark.range(50_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("a"), F.lit(1.0).alias("b"))
    old, new, same = (str(tmp_path / n) for n in ("old", "new", "same"))
    S.write_snapshot(df, old, ["k"])
    S.write_snapshot(df.withColumn("b", F.when(F.col("k") == 777, 2.0).otherwise(F.col("b"))), new, ["k"])
    S.write_snapshot(df.repartition(3, "b"), same, ["k"])
    assert S.differing(spark, old, same) == []
    (bucket,) = S.differing(spark, old, new)
    assert 0 < S.read_snapshot(spark, new, df.schema, [bucket]).count() < 100
    (row,) = S.stored_diff(spark, old, new, df.schema, ["k"], ["b"]).collect()
    assert (row.k, row.op, row.old_value, row.new_value) == (777, "UPDATE", 1.0, 2.0)
    assert {r.side: r.n for r in S.stored_reconcile(spark, old, new, df.schema, ["k"]).collect()} == {"same": 49_999, "changed": 1}
    assert S.stored_diff(spark, old, same, df.schema, ["k"], ["b"]).count() == 0


def test_same_as_comparing_all_rows(spark, tmp_path):
    """Random changes, missing values that trade places, and an empty side."""
    rng = random.Random(5)
    rows = {k: (k, rng.choice([None, "x", "y"]), rng.choice([None, 0.5, 1.5])) for k in range(300)}
    other = {k: v for k, v in rows.items() if rng.random() > 0.05}
    other |= {k: (k, "new", None) for k in range(300, 310)} | {7: (7, None, 0.5)}
    rows[7] = (7, "x", None)
    frames = {n: spark.createDataFrame(list(d.values()), KIND) for n, d in (("a", rows), ("b", other), ("none", {}))}
    for n, df in frames.items():
        S.write_snapshot(df, str(tmp_path / n), ["k"])
    as_set = lambda df: sorted(map(str, df.collect()))
    for x, y in (("a", "b"), ("b", "a"), ("none", "a"), ("a", "none"), ("none", "none")):
        paths, schema = [str(tmp_path / n) for n in (x, y)], frames["a"].schema
        assert as_set(S.stored_diff(spark, *paths, schema, ["k"], ["a", "b"])) == as_set(H.snapshot_diff(frames[x], frames[y], ["k"], ["a", "b"]))
        assert as_set(S.stored_reconcile(spark, *paths, schema, ["k"])) == as_set(H.full_reconcile(frames[x], frames[y], ["k"]))
    with pytest.raises(ValueError):
        S.write_snapshot(frames["a"].withColumn("bucket", F.lit(1)), str(tmp_path / "c"), ["k"])
