"""A ledger of findings over runs: when each was first and last seen, when it went, how often it came back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import as_date, day_literal

_STATE = ["first_seen", "last_seen", "resolved_at", "reopened", "status"]


def merge_run(ledger: DataFrame | None, findings: DataFrame, as_of) -> DataFrame:
    """The ledger after a run: the finding columns and first_seen, last_seen, resolved_at, reopened, status.

    A finding is known by its id, which is the same in every run. One that is found again keeps its first day and takes the run's other columns; one that
    was resolved is reopened; one no longer found keeps its last form and is resolved on the run's day. A finding that
    its detector dates earlier (an edit) is first seen on that day. Repeated ids count once.
    """
    day = day_literal(as_of)
    columns = [f.name for f in model.FINDING_SCHEMA.fields]
    now = findings.select(*columns).dropDuplicates(["finding_id"])
    if ledger is None:
        started = now.withColumn("first_seen", F.least(F.coalesce("detected_at", day), day))
        return started.select(*columns, "first_seen", day.alias("last_seen"), F.lit(None).cast("date").alias("resolved_at"), F.lit(0).alias("reopened"), F.lit("open").alias("status"))
    old = ledger.select("finding_id", F.struct(*[c for c in columns if c != "finding_id"], *_STATE).alias("o"))
    new = now.select("finding_id", F.struct(*[c for c in columns if c != "finding_id"]).alias("n"))
    both = old.join(new, "finding_id", "full")
    found, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    kept = [F.when(found, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns if c != "finding_id"]
    back = found & known & F.col("o.resolved_at").isNotNull()
    return both.select(
        "finding_id", *kept,
        F.when(known, F.col("o.first_seen")).otherwise(F.least(F.coalesce("n.detected_at", day), day)).alias("first_seen"),
        F.when(found, day).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(~found, F.coalesce("o.resolved_at", day)).alias("resolved_at"),
        (F.coalesce("o.reopened", F.lit(0)) + back.cast("int")).alias("reopened"),
        F.when(~found, "resolved").when(back | (F.col("o.status") == "reopened"), "reopened").otherwise("open").alias("status"),
    )


def _runs(spark: SparkSession, path: str) -> list[dt.date]:
    """Days of the finished runs under a ledger's folder, ascending: one folder per run."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [f.getPath() for f in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(dt.date.fromisoformat(p.getName().removeprefix("run=")) for p in done if p.getName().startswith("run="))


def read_ledger(spark: SparkSession, path: str, before=None) -> DataFrame | None:
    """The latest version, or the latest of a run before a day; None if there is none."""
    runs = [d for d in _runs(spark, path) if before is None or d < as_date(before)]
    return spark.read.parquet(f"{path}/run={runs[-1].isoformat()}") if runs else None


def record_run(findings: DataFrame, path: str, as_of) -> DataFrame:
    """Merges a run's findings into the ledger under ``path`` as a version of its own and returns that version.

    A version is written whole and counts once it is complete, so a job that dies leaves the earlier ones as they are. The same day run again starts
    from the version before that day and replaces only its own. A day before the last run is refused: later versions build on it.
    """
    spark = findings.sparkSession
    day = as_date(as_of)
    if (runs := _runs(spark, path)) and day < runs[-1]:
        raise ValueError(f"the ledger has a later run, of {runs[-1]}")
    version = f"{path}/run={day.isoformat()}"
    merge_run(read_ledger(spark, path, day), findings, day).write.mode("overwrite").parquet(version)
    return spark.read.parquet(version)


def with_first_seen(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings dated by the day on which the ledger has first seen them."""
    first = ledger.select("finding_id", F.col("first_seen").alias("_first"))
    dated = findings.join(first, "finding_id", "left").withColumn("detected_at", F.coalesce("_first", "detected_at"))
    return dated.select(*findings.columns)
