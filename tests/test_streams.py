"""Streams: replay, restarts, and agreement with the batch result."""

import pytest
from pyspark.sql import functions as F

from tableward.streaming import ingest as X

WEEKS = [
    "ts < DATE '2024-01-08'",
    "ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15'",
    "ts >= DATE '2024-01-15' AND ts < DATE '2024-01-22'",
    "ts >= DATE '2024-01-22'",
]


@pytest.fixture
def weeks(spark, folder, tmp_path):
    """Events in four files whose order of writing follows event time."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    path = str(tmp_path / "landing")
    for where in WEEKS:
        events.filter(where).coalesce(1).write.mode("append").parquet(path)
    return events, path


def audit(stream):
    return stream.select(
        "event_id",
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table_name"),
        F.col("user_id").cast("string").alias("user_email"),
        F.col("ts").alias("event_time"),
        F.when(F.col("user_id") % 2 == 0, "JOB").alias("entity_type"),
    )


def to_the_end(spark, events, path, tmp_path, windows):
    ahead = events.filter("user_id % 2 = 1").limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    return X.run_to_end(spark, path, events.schema, lambda s: windows(audit(s)), ahead, str(tmp_path / "sink"), str(tmp_path / "check"), max_files=1)


def test_ingest_is_exactly_once(spark, weeks, tmp_path):
    events, path = weeks
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    first = X.ingest(spark, path, events.schema, sink, check)
    assert first.exceptAll(events).count() == 0 and first.count() == events.count()
    assert X.ingest(spark, path, events.schema, sink, check).count() == events.count()
    events.limit(5).withColumn("event_id", F.col("event_id") + 10**9).write.mode("append").parquet(path)
    assert X.ingest(spark, path, events.schema, sink, check).count() == events.count() + 5


def test_alerts_over_many_batches_equal_batch(spark, weeks, tmp_path):
    events, path = weeks
    out = to_the_end(spark, events, path, tmp_path, X.direct_write_alerts)
    got = {(r.day, r.table_name): r.n for r in out.collect()}
    direct = audit(events).filter("entity_type IS NULL")
    want = {
        (r.day, r.table_name): r.n
        for r in direct.groupBy(F.to_date("event_time").alias("day"), "table_name").agg(F.count("*").alias("n")).collect()
    }
    assert got == want


def test_sessions_equal_batch(spark, weeks, tmp_path):
    events, path = weeks
    out = to_the_end(spark, events, path, tmp_path, X.edit_sessions)
    got = {(r.user_email, r.started, r.ended, r.edits) for r in out.collect()}
    batch = (
        audit(events).withColumn("event_time", F.col("event_time").cast("timestamp"))
        .groupBy(F.session_window("event_time", "30 minutes").alias("w"), "user_email").agg(F.count("*").alias("edits"))
        .select("user_email", "w.start", "w.end", "edits")
    )
    want = {tuple(r) for r in batch.collect()}
    assert got == want


def test_dedup_across_batches(spark, weeks, tmp_path):
    events, path = weeks
    events.filter(WEEKS[3]).coalesce(1).write.mode("append").parquet(path)
    sink = str(tmp_path / "sink")
    source = X.file_stream(spark, path, events.schema, max_files=1).select("event_id", F.col("ts").alias("event_time"))
    stream = X.dedup(source, "event_time", ["event_id"], "10 days")
    X.run_to_files(stream, sink, str(tmp_path / "check"))
    assert X.read_sink(spark, sink, stream.schema).count() == events.count()


def test_changes_over_many_batches(spark, weeks, tmp_path):
    events, path = weeks
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("op")
    feed = X.file_stream(spark, path, events.schema, max_files=1).select("user_id", "ts", "event_id", "value", op)
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    X.apply_changes(feed, sink, check, ["user_id"], ["ts", "event_id"])
    got = X.current_rows(spark, sink, feed.schema, ["user_id"], ["ts", "event_id"])
    last = events.groupBy("user_id").agg(F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id")).alias("r"))
    want = {(r.user_id, r.r.value) for r in last.filter("r.event_type <> 'error'").collect()}
    assert {(r.user_id, r.value) for r in got.collect()} == want
    assert X.fold_changes(spark, sink, feed.schema, ["user_id"], ["ts", "event_id"]) == 3
    assert X.fold_changes(spark, sink, feed.schema, ["user_id"], ["ts", "event_id"]) == 3
    late = events.limit(20).withColumn("ts", F.col("ts") - F.expr("INTERVAL 90 DAYS")).withColumn("event_type", F.lit("view"))
    late.coalesce(1).write.mode("append").parquet(path)
    X.apply_changes(feed, sink, check, ["user_id"], ["ts", "event_id"])
    again = X.current_rows(spark, sink, feed.schema, ["user_id"], ["ts", "event_id"])
    assert {(r.user_id, r.value) for r in again.collect()} == want


def test_late_rows_are_kept(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    path, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))
    for where in WEEKS[:3]:
        events.filter(where).filter("event_id % 100 <> 0").coalesce(1).write.mode("append").parquet(path)
    events.filter(f"{WEEKS[3]} OR event_id % 100 = 0").coalesce(1).write.mode("append").parquet(path)
    X.split_late(X.file_stream(spark, path, events.schema, max_files=1), out, check, "ts", 2)
    got = {r.status: r.n for r in X.late_counts(spark, out, events.schema).collect()}
    assert sum(got.values()) == events.count()
    assert 0 < got["late"] <= events.filter("event_id % 100 = 0").count()


def test_rules_report_metrics(spark, weeks, tmp_path):
    events, path = weeks
    stream = X.checked(X.file_stream(spark, path, events.schema), {"small": "value < 50"}, "warn", "rules")
    query = (
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = sum(p["observedMetrics"]["rules"]["small"] for p in query.recentProgress if p["numInputRows"])
    assert seen == events.filter("value >= 50").count()
