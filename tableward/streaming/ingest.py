"""Checkpointed file streams: ingest, dedup, windows, rules, change feeds, late rows.

Each ``start``-like function runs the stream over what is there now and stops (``availableNow``); run again
with the same checkpoint it takes up only what is new. Checkpoints and sinks belong in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.functions.common import is_direct_write
from tableward.operators.changes import upsert_scd1
from tableward.operators.quality import expectations

#: Setting with which one busy user's rows become few before the shuffle; it belongs where the session is made.
MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """Parquet files under ``path`` (a folder or a glob) as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need an instant, so a local timestamp is cast in the session's zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to parquet files exactly once: the sink's log and the checkpoint agree on each batch."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch under its own folder; a repeated batch overwrites only itself."""
    run_batches(
        stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}"), checkpoint
    )


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a sink written plainly or by batch."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def run_to_end(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    windows: Callable[[DataFrame], DataFrame],
    ahead: DataFrame,
    path: str,
    checkpoint: str,
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """Windows of a stream that has ended, all of them.

    What has arrived is run first. Then ``ahead``, a row whose time lies beyond every open window and the delay, is added to the source: it moves
    the watermark past all windows, so they are written, while its own stays open. Rows that come after that are
    late, so this is for the end of a stream.
    """
    for last in (False, True):
        if last:
            ahead.select(*schema.names).write.mode("append").parquet(source)
        run_to_files(windows(file_stream(spark, source, schema, max_files, max_bytes)), path, checkpoint)
    return read_sink(spark, path, windows(spark.readStream.schema(schema).parquet(source)).schema)


def ingest(
    spark: SparkSession, source: str, schema: T.StructType, path: str, checkpoint: str, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """Load new files into the sink and give its rows; a first load of very many files is taken in batches of a bounded size."""
    run_to_files(file_stream(spark, source, schema, max_files, max_bytes), path, checkpoint)
    return read_sink(spark, path, schema)


def dedup(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Drop repeats that arrive within the delay; state for older keys is freed."""
    return event_time(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def direct_write_alerts(stream: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Direct writes per table and day. A day is given once the watermark has passed its end."""
    return (
        event_time(stream.filter(is_direct_write()), "event_time", delay)
        .groupBy(F.window("event_time", width).alias("w"), "table_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), "table_name", "n")
    )


def edit_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Bursts of edits by one user. Sessions that set ``MERGE_SESSIONS`` to true merge them before the shuffle."""
    return (
        event_time(stream, "event_time", delay)
        .groupBy(F.session_window("event_time", gap).alias("w"), "user_email")
        .agg(F.count(F.lit(1)).alias("edits"))
        .select("user_email", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "edits")
    )


def checked(stream: DataFrame, rules: dict[str, str], policy: str = "drop", observe: str | None = None) -> DataFrame:
    """The batch rules on a stream; ``observe`` makes the counts part of each batch's progress report."""
    return expectations(stream, rules, policy, observe)


def apply_changes(
    stream: DataFrame, path: str, checkpoint: str, key: list[str], seq: list[str], op: str = "op"
) -> None:
    """Store each batch's latest change per key under its own folder.

    A batch writes only what it brings, and a repeated batch overwrites its own folder, so retries
    are safe. ``current_rows`` merges on read.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        latest = (
            batch.groupBy(*key)
            .agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row"))
            .select(*key, "_row.*")
        )
        latest.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, each, checkpoint)


_FOLDED = T.StructType([T.StructField("upto", T.LongType())])


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """Latest changes of the last snapshot and of the batches after it, and the number of the last batch it holds (-1: no snapshot)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-folded")
    upto = -1
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        upto = spark.read.schema(_FOLDED).parquet(f"{path}-folded").agg(F.max("upto")).first()[0]
    numbered = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(numbered).parquet(path).filter(F.col("batch_id") > upto).select(*schema.names)
    if upto >= 0:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}-snapshots/upto={upto}"))
    return rows, upto


def fold_changes(spark: SparkSession, path: str, schema: T.StructType, key: list[str], seq: list[str]) -> int:
    """Fold all batches stored so far into a new snapshot; returns the last batch it holds.

    Deletes stay in it, so that older changes which come later don't bring a row back. The note that a snapshot is
    complete is written after it, so a fold that fails is as if it had not been. Afterwards ``current_rows`` reads the
    snapshot and only the batches after it.
    """
    rows, upto = _stored(spark, path, schema)
    last = spark.read.schema(T.StructType([T.StructField("batch_id", T.LongType())])).parquet(path).agg(F.max("batch_id")).first()[0]
    if last is None or last <= upto:
        return upto
    rest = [c for c in schema.names if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row")).select(*key, "_row.*")
    latest.select(*schema.names).write.mode("overwrite").parquet(f"{path}-snapshots/upto={last}")
    spark.createDataFrame([(last,)], _FOLDED).coalesce(1).write.mode("append").parquet(f"{path}-folded")
    return last


def current_rows(
    spark: SparkSession, path: str, schema: T.StructType, key: list[str], seq: list[str], op: str = "op"
) -> DataFrame:
    return upsert_scd1(_stored(spark, path, schema)[0], key, seq, op)


def split_late(stream: DataFrame, path: str, checkpoint: str, time: str, delay_days: int) -> None:
    """Rows behind the high-water mark of earlier batches go to ``status=late``, others to ``status=on_time``.

    Nothing is lost: both sides are kept. Each batch stores the running mark, the greatest time up to and with it, observed while the rows
    are written. A batch reads the mark of the one before it alone, so its work does not grow with the number of batches, and a repeated
    batch decides the same way.
    """
    spark = stream.sparkSession
    mark_schema = T.StructType([T.StructField("mark", T.TimestampType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        mark = None
        if batch_id > 0:
            mark = spark.read.schema(mark_schema).parquet(f"{path}/marks/batch_id={batch_id - 1}").first()[0]
        when = F.col(time).cast("timestamp")
        late = F.lit(False)
        if mark is not None:
            late = when < F.lit(mark) - F.expr(f"INTERVAL {int(delay_days)} DAYS")
        seen = Observation()
        status = F.when(late, "late").otherwise("on_time")
        rows = batch.observe(seen, F.max(when).alias("mark")).withColumn("status", status)
        rows.write.mode("overwrite").partitionBy("status").parquet(f"{path}/rows/batch_id={batch_id}")
        marks = [m for m in (mark, seen.get["mark"]) if m is not None]
        found = spark.createDataFrame([(max(marks, default=None),)], mark_schema)
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    run_batches(stream, each, checkpoint)


def late_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("status", T.StringType())])
    rows = spark.read.schema(full).parquet(f"{path}/rows")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
