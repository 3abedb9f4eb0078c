"""Pipeline health: failure rates, anti-patterns and status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import in_window, is_false, is_true, ratio


def failure_rate(runs: DataFrame, as_of=None, window_days: int | None = 30) -> DataFrame:
    """Failed / total runs per pipeline; ``window_days=None`` uses all history."""
    kept = runs.filter(F.col("pipeline_id").isNotNull())
    if window_days is not None:
        kept = kept.filter(in_window(kept, "start_time", as_of, window_days))
    return (
        kept.groupBy("pipeline_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("status") == "failed").alias("failed_runs"),
        )
        .withColumn("failure_rate", ratio(F.col("failed_runs"), F.col("total_runs")))
    )


def anti_pattern_count() -> Column:
    return (
        is_false("has_owner_tag").cast("int")
        + is_false("has_dq_expectations").cast("int")
        + is_true("uses_hardcoded_paths").cast("int")
    )


def anti_patterns(pipelines: DataFrame) -> DataFrame:
    return pipelines.select("pipeline_id", anti_pattern_count().alias("anti_pattern_count"))


def basic_status(rate: Column) -> Column:
    return (
        F.when(rate > model.FAILURE_CRITICAL, "critical")
        .when((rate > model.FAILURE_WARNING) | is_false("has_owner_tag"), "warning")
        .otherwise("healthy")
    )


def strict_status(rate: Column) -> Column:
    unowned_production = is_false("has_owner_tag") & is_true("is_production")
    return (
        F.when((rate > model.FAILURE_CRITICAL) | unowned_production, "critical")
        .when((rate > model.FAILURE_WARNING) | is_false("has_dq_expectations"), "warning")
        .otherwise("healthy")
    )


STATUS_RULES = {"basic": basic_status, "strict": strict_status}


def health(
    pipelines: DataFrame, runs: DataFrame, as_of=None, rule: str = "strict", window_days: int | None = 30
) -> DataFrame:
    """One row per pipeline. Runs are reduced to one row per pipeline before the join."""
    rates = failure_rate(runs, as_of, window_days).select("pipeline_id", "failure_rate")
    rate = F.coalesce("failure_rate", F.lit(0.0))
    return pipelines.join(rates, "pipeline_id", "left").select(
        "pipeline_id",
        "pipeline_name",
        "owner_email",
        "has_owner_tag",
        "is_production",
        "has_dq_expectations",
        "uses_hardcoded_paths",
        rate.alias("failure_rate_30d"),
        "avg_duration_sec",
        anti_pattern_count().alias("anti_pattern_count"),
        STATUS_RULES[rule](rate).alias("health_status"),
    )


def run_status(rates: DataFrame) -> DataFrame:
    rate = F.col("failure_rate")
    label = (
        F.when(rate > model.FAILURE_CRITICAL, "failed")
        .when(rate > model.FAILURE_WARNING, "warning")
        .otherwise("succeeded")
    )
    return rates.select("pipeline_id", label.alias("run_status"))


def without_dq(pipelines: DataFrame) -> DataFrame:
    return pipelines.filter(is_false("has_dq_expectations")).select("pipeline_id")


def hardcoded_paths(pipelines: DataFrame) -> DataFrame:
    return pipelines.filter("uses_hardcoded_paths").select("pipeline_id")


def top_failing(pipeline_health: DataFrame, n: int = 15) -> DataFrame:
    return (
        pipeline_health.filter(F.col("failure_rate_30d") > 0)
        .orderBy(F.desc("failure_rate_30d"), "pipeline_id")
        .limit(n)
        .select("pipeline_id", "failure_rate_30d", "health_status")
    )


def classic_compute_jobs(jobs: DataFrame, managed: str = "serverless", saving: float = 0.4) -> DataFrame:
    """Jobs off the managed compute type, with the saving of moving them."""
    return (
        jobs.filter(~F.col("cluster_type").eqNullSafe(managed))
        .groupBy("cluster_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("annual_cost_usd").alias("_cost"))
        .select("cluster_type", "n", F.round(F.col("_cost").cast("double") * saving, 2).alias("est_saving"))
    )
