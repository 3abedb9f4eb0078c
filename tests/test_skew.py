"""Hot keys: results must not depend on how they are split."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableward.functions.skew import with_neighbour, with_position, with_rank_by_count
from tableward.operators import changes, lineage, runs

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def feed_rows():
    rng = random.Random(7)
    rows = []
    for n in range(3000):
        key = 0 if n % 3 == 0 else rng.randrange(1, 40)
        at = START + dt.timedelta(seconds=rng.randrange(5000))  # many ties in time
        rows.append((key, at, n, rng.choice([1, 2, None]), rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])))
    return rows


@pytest.fixture(scope="module")
def feed(spark, feed_rows):
    return spark.createDataFrame(feed_rows, "k int, ts timestamp, id int, v int, op string").repartition(7)


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("forward", [False, True])
def test_neighbour(feed, feed_rows, forward):
    got = with_neighbour(feed, ["k"], ["ts", "id"], ["id"], "near", forward)
    assert got.count() == len(feed_rows)
    want = {}
    for rows in by_key(feed_rows).values():
        for k, r in enumerate(rows):
            at = k + 1 if forward else k - 1
            want[r[2]] = rows[at][2] if 0 <= at < len(rows) else None
    assert {r.id: r.near.id if r.near else None for r in got.collect()} == want


def test_one_key_at_one_time_is_spread(spark):
    """5,000 rows of one key at one instant lie in several partitions and still find their neighbours."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.lit(START).alias("ts"), "id").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    parts = df.repartitionByRange("k", "ts", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2500
    got = {r.id: r.near.id if r.near else None for r in with_neighbour(df, ["k"], ["ts", "id"], ["id"], "near").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: k - 1 if k else None for k in range(5000)}


def test_history_and_state(feed, feed_rows):
    got = changes.scd2_history(feed, ["k"], ["ts", "id"], ["v"])
    want = []
    for key, rows in by_key(feed_rows).items():
        opened = None
        for _, at, _, v, op in rows:
            if opened and (op == "DELETE" or v != opened[1]):
                want.append((key, opened[1], opened[0], at))
                opened = None
            if op != "DELETE" and opened is None:
                opened = (at, v)
        if opened:
            want.append((key, opened[1], opened[0], None))
    have = [(r.k, r.v, r.valid_from, r.valid_to) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    now = {r.k: r.v for r in changes.upsert_scd1(feed, ["k"], ["ts", "id"]).collect()}
    current = got.filter("is_current").collect()
    assert {r.k: r.v for r in current} == now
    assert len(current) == len(now)


def test_retries(feed, feed_rows):
    timeline = feed.select(
        F.col("k").alias("pipeline_id"),
        F.col("ts").alias("start_time"),
        F.col("id").alias("run_id"),
        F.when(F.col("op") == "DELETE", "failed").otherwise("succeeded").alias("status"),
        F.col("id").alias("target_rows"),
    )
    want = set()
    for rows in by_key(feed_rows).values():
        want |= {b[2] for a, b in zip(rows, rows[1:]) if a[4] == "DELETE"}
    assert {r.run_id for r in runs.retry_after_failure(timeline).collect()} == want
    assert {r.run_id for r in runs.duplicate_load_signal(timeline).collect()} <= want


def test_position_with_one_common_value(spark):
    df = spark.range(5000).select(F.lit(1).alias("x"), F.xxhash64("id").alias("id")).repartition(11)
    placed = with_position(df, [F.desc("x"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in placed] == list(range(1, 5001))
    assert [r.id for r in placed] == sorted(r.id for r in placed)


def test_rank_by_count(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "t string, n int")
    got = {r.t: r["rank"] for r in with_rank_by_count(df, "n").collect()}
    assert got == {"c": 1, "a": 2, "b": 2, "d": 4}


def test_wide_blast_radius_keeps_every_name(spark):
    wide = spark.range(5000).select(F.lit("hub").alias("source"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("target"))
    got = lineage.blast_radius(wide.unionByName(wide)).collect()
    assert {r.downstream_count for r in got} == {5000}
    assert sorted(r.downstream_table for r in got) == sorted(f"t{k}" for k in range(5000))
    assert lineage.downstream_counts(wide).first().downstream_count == 5000


def test_long_chain_is_closed(spark):
    chain = spark.range(40).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    got = lineage.lineage_closure(chain)
    assert got.count() == 40 * 41 // 2 and got.agg(F.max("min_depth")).first()[0] == 40
    start = spark.createDataFrame([("38",), ("40",)], "table_id string")
    assert sorted((r.source, r.target) for r in lineage.lineage_closure(chain, start).collect()) == [("38", "39"), ("38", "40")]
