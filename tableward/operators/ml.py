"""Machine-learning assets: stale experiments and models on raw features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import day_literal, has_value, in_window, is_direct_write, is_false
from tableward.operators.direct_writes import edit_counts
from tableward.operators.lineage import rerun_cost
from tableward.session import keep


def stale_experiments(experiments: DataFrame, as_of, days: int = model.STALE_DAYS) -> DataFrame:
    """Experiments without a run for over ``days`` days; one that never ran has no days."""
    idle = F.datediff(day_literal(as_of), F.to_date("last_run_date"))
    shown = [c for c in ("experiment_name",) if c in experiments.columns]
    return experiments.filter(idle.isNull() | (idle > days)).select("experiment_id", *shown, idle.alias("days_since_run"))


def governance_gaps(experiments: DataFrame) -> DataFrame:
    no_owner, no_description, no_model = (
        ~has_value("owner_email"),
        is_false("has_description"),
        is_false("has_registered_model"),
    )
    return experiments.select(
        "experiment_id",
        no_owner.alias("no_owner"),
        no_description.alias("no_description"),
        no_model.alias("no_model"),
        (no_owner.cast("int") + no_description.cast("int") + no_model.cast("int")).alias("gaps"),
    )


def stale_feature_models(
    models: DataFrame, writes: DataFrame, tables: DataFrame, as_of, days: int = model.STALE_DAYS
) -> DataFrame:
    """Models whose bronze features table was written by hand in the last ``days`` days."""
    last = (
        writes.filter(is_direct_write() & in_window(writes, "event_time", as_of, days))
        .groupBy(F.col("table_id").alias("features_table"))
        .agg(F.max("event_time").alias("last_write"))
    )
    bronze = tables.filter(F.col("data_layer") == "bronze").select(F.col("table_id").alias("features_table"))
    shown = [c for c in ("model_name",) if c in models.columns]
    return (
        models.select("model_id", *shown, F.col("upstream_features_table").alias("features_table"))
        .join(bronze, "features_table", "left_semi")
        .join(last, "features_table")
        .select("model_id", *shown, "features_table", "last_write")
    )


def stale_model_root_cause(
    stale: DataFrame, writes: DataFrame, runs: DataFrame, reads: DataFrame, as_of, runs_as_of, price_per_hour: float = 1.0
) -> DataFrame:
    """Edits and rerun cost of the features tables of stale models; nothing is computed for other tables."""
    stale = keep(stale, "stale-models")
    wanted = stale.select(F.col("features_table").alias("table_id")).distinct()
    counts = edit_counts(writes.join(wanted, "table_id", "left_semi"), as_of, key="table_id").select("table_id", F.col("edit_count_90d").alias("edit_count"))
    costs = rerun_cost(runs, reads.join(wanted, "table_id", "left_semi"), runs_as_of, price_per_hour)
    none = F.lit(0).cast("decimal(18,2)")
    cause = counts.join(costs, "table_id", "left").select(F.col("table_id").alias("features_table"), "edit_count", F.coalesce("rerun_cost_usd", none).alias("rerun_cost_usd"))
    return stale.join(cause, "features_table", "left").select("model_id", "features_table", "edit_count", "rerun_cost_usd")


def unregistered(models: DataFrame) -> DataFrame:
    return models.filter(is_false("is_registered")).select("model_id")


def unused(models: DataFrame) -> DataFrame:
    return models.filter(F.col("serving_endpoint_name").isNull()).select("model_id")
