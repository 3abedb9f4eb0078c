"""Signals from run history: retries, reloads, failures by week and trigger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import as_date, ratio, time_literal
from tableward.functions.skew import with_neighbour
from tableward.session import keep

#: Entries of a quantile sketch; ranks are off by at most one in so many.
MEDIAN_ACCURACY = 10_000

def full_rescan_signal(runs: DataFrame, min_runs: int = 5) -> DataFrame:
    """Trend of run duration over time and over the target's rows, per pipeline.

    A steady rise hints at full rescans: a run that takes longer with every row the target has (``row_r2`` near 1) reads all of it.
    """
    day = F.unix_micros(F.col("start_time").cast("timestamp")) / F.lit(86_400_000_000)
    seconds = F.col("duration_sec").cast("double")
    return (
        runs.filter(F.col("pipeline_id").isNotNull())
        .select("pipeline_id", seconds.alias("y"), day.alias("x"), F.col("table_rows").cast("double").alias("r"))
        .groupBy("pipeline_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.regr_slope("y", "x"), 4).alias("slope"),
            F.round(F.regr_r2("y", "x"), 4).alias("r2"),
            F.round(F.regr_slope("y", "r"), 4).alias("row_slope"),
            F.round(F.regr_r2("y", "r"), 4).alias("row_r2"),
        )
        .filter(F.col("n") >= min_runs)
    )


def retry_after_failure(runs: DataFrame) -> DataFrame:
    """Runs whose previous run of the same pipeline failed or was cancelled."""
    known = runs.filter(F.col("pipeline_id").isNotNull()).select("pipeline_id", "run_id", "start_time", "status")
    return (
        with_neighbour(known, ["pipeline_id"], ["start_time", "run_id"], ["status"], "_prev")
        .select("run_id", "pipeline_id", F.col("_prev.status").alias("prev_status"))
        .filter(F.col("prev_status").isin("failed", "cancelled"))
    )


def duplicate_load_signal(timeline: DataFrame, factor: float = 1.5) -> DataFrame:
    """Retries after which the target grew by more than one ordinary run's rows.

    The ordinary growth is the (lower) median over runs that followed a success, from a mergeable sketch of bounded size per
    pipeline. Its rank is off by at most one in ``MEDIAN_ACCURACY``, so it is exact for pipelines with fewer such runs.
    """
    known = timeline.filter(F.col("pipeline_id").isNotNull()).select(
        "pipeline_id", "run_id", "start_time", "status", F.col("target_rows").cast("decimal(18,2)").alias("target_rows")
    )
    stepped = with_neighbour(known, ["pipeline_id"], ["start_time", "run_id"], ["status", "target_rows"], "_prev")
    stepped = stepped.withColumn("growth", F.col("target_rows") - F.col("_prev.target_rows"))
    stepped = keep(stepped, "growth")  # read twice below
    ordinary = (
        stepped.filter((F.col("_prev.status") == "succeeded") & (F.col("growth") > 0))
        .groupBy("pipeline_id")
        .agg(F.percentile_approx(F.col("growth").cast("double"), 0.5, MEDIAN_ACCURACY).alias("_usual"))
    )
    return (
        stepped.filter(F.col("_prev.status").isin("failed", "cancelled"))
        .join(ordinary, "pipeline_id")
        .select(
            "pipeline_id",
            "run_id",
            F.col("growth").cast("double").alias("growth"),
            F.round(F.col("growth").cast("double") / F.col("_usual"), 3).alias("ratio"),
        )
        .filter(F.col("ratio") > factor)
    )


def write_path_mix(writes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))

    def share(condition):
        return ratio(F.count_if(condition), n, 4)

    known = F.coalesce("entity_type", F.lit(""))
    return writes.groupBy("table_name").agg(
        share(known == "PIPELINE").alias("pipeline_share"),
        share(known == "JOB").alias("job_share"),
        share(~known.isin("PIPELINE", "JOB")).alias("adhoc_share"),
    )


def external_db_ingest(lineage: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Pipelines or jobs that read straight from an external database."""
    external = (
        lineage.filter((F.col("source_kind") == "external_database") & F.col("entity_type").isin("PIPELINE", "JOB"))
        .select(F.col("entity_id").alias("pipeline_id"), "source")
        .distinct()
    )
    return external.join(pipelines.select("pipeline_id"), "pipeline_id", "left_semi")


def run_status_mix(runs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    shares = [ratio(F.count_if(F.col("status") == s), n, 4).alias(s) for s in model.RUN_STATUSES]
    return runs.groupBy("triggered_by").agg(*shares)


def weekly_failures(runs: DataFrame, as_of, weeks: int = 52) -> DataFrame:
    """Number of the last full ``weeks`` weeks in which each pipeline failed."""
    end = as_date(as_of)
    monday = end - dt.timedelta(days=end.weekday())
    failed = runs.filter(
        F.col("pipeline_id").isNotNull()
        & (F.col("status") == "failed")
        & (F.col("start_time") >= time_literal(runs, "start_time", monday - dt.timedelta(weeks=weeks)))
        & (F.col("start_time") < time_literal(runs, "start_time", monday))
    )
    return (
        failed.select("pipeline_id", F.to_date(F.date_trunc("week", "start_time")).alias("week"))
        .distinct()
        .groupBy("pipeline_id")
        .agg(F.count(F.lit(1)).alias("weeks_with_failure"))
        .withColumn("every_week", F.col("weeks_with_failure") >= weeks)
    )


def blocked_dependents(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """How many assets hang directly on each unowned or failing asset (``blocked.asset_id``)."""
    return (
        edges.select(F.col("source").alias("asset_id"), "target")
        .join(blocked.select("asset_id"), "asset_id", "left_semi")
        .distinct()
        .groupBy("asset_id")
        .agg(F.count(F.lit(1)).alias("dependents"))
    )


def row_count_anomaly(df: DataFrame, time: str, z: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Day-on-day change of the row count against the seven changes before it, of the whole or per ``keys``.

    Rows are counted per key and day first; the windows run over one row per day.
    """
    by_day = Window.partitionBy(*keys).orderBy("day")
    before = by_day.rowsBetween(-7, -1)
    daily = df.groupBy(*keys, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    delta = F.col("n") - F.lag("n").over(by_day)
    score = F.round(F.try_divide(F.col("_d") - F.avg("_d").over(before), F.stddev_samp("_d").over(before)), 4)
    return (
        daily.withColumn("_d", delta.cast("double"))
        .withColumn("z", score)
        .select(*keys, "day", "n", "z", F.coalesce(F.abs("z") > z, F.lit(False)).alias("anomaly"))
    )
